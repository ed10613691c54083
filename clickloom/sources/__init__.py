"""Reading and writing click logs and score files."""
