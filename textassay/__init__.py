"""Content-quality analytics expressed as Spark DataFrame jobs."""
