"""Document search and analytics over Spark DataFrames."""
