"""Security findings as Spark DataFrame jobs."""
