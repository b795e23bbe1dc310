"""dqloom: data-quality operators for Spark DataFrames."""
