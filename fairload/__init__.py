"""Fair-share resource analytics expressed as Spark DataFrame, SQL and streaming jobs."""
