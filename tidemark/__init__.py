"""Point-in-time cohort analytics on Spark DataFrames."""
