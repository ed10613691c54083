"""Feature operators. Each takes a prepared click log and returns it with columns added."""
