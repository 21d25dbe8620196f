"""textloom: full-text search, ranking and text data processing on Spark DataFrames."""
