"""Knowledge compilation and retrieval on Spark DataFrames."""
