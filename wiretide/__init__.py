"""Traffic analytics on Spark: captures in, relational answers out."""
