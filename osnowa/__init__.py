"""osnowa: corpus analytics on Spark DataFrames."""
