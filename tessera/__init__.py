"""Content-pipeline analytics on PySpark: DataFrames in, DataFrames out."""
