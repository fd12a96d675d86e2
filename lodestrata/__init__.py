"""Point-cloud and building-document analytics on Spark DataFrames."""
