"""Document segmentation analytics on Spark DataFrames."""
