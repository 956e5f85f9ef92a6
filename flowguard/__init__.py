"""Network-threat analytics over log data, expressed as Spark DataFrame jobs."""
