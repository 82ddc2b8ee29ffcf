"""Point-in-time card-risk analytics on Spark DataFrames."""
