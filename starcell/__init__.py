"""starcell: dimensional analytics for telecom data, as Spark DataFrame jobs."""
