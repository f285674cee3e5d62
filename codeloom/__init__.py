"""Code-structure analytics on Spark DataFrames."""
