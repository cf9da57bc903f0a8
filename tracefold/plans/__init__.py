"""Named queries (Spark) and their SQL twins."""
