"""Click-log features and conversion scoring as Spark jobs."""
