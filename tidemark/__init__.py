"""tidemark: API change-impact analytics as Spark DataFrames."""
