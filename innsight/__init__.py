"""Property-registry analytics on Spark: functions from DataFrames to DataFrames."""
