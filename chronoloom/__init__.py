"""chronoloom: timeline analytics on PySpark DataFrames."""
