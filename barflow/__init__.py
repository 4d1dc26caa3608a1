"""Market-bar jobs on Spark: every job is a function from DataFrames to DataFrames."""
