"""Feature presets and the three runs built from them."""
