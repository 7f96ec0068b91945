"""Market and panel analytics on Spark DataFrames."""
