"""Bar-data store and query layer on Spark DataFrames."""
