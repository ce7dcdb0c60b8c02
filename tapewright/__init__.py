"""Market-tape quality checks and publishable series as Spark DataFrame jobs."""
