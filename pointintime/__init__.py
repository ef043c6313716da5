"""Point-in-time document evidence on Spark."""
