"""Community-trait analytics on survey tables, written as Spark DataFrame jobs."""
