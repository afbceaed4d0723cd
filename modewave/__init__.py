"""Joint space-time mode analysis of gridded, multi-variable series on Spark DataFrames."""
