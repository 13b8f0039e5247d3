"""Time-series anomaly analytics on Spark DataFrames."""
