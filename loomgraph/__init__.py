"""Repository analytics on Spark: files, imports, commits and documents as DataFrames."""
