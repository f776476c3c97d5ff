"""Operators for item catalogues, similarity search and collections, on PySpark DataFrames."""
