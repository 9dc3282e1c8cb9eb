"""Graph-grammar analytics on Spark DataFrames."""
