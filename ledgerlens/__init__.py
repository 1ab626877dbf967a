"""Transaction-fraud features, statistics and experiment analytics on Spark DataFrames."""
