"""lodemine: discriminative pattern mining and corpus preparation on Spark DataFrames."""
