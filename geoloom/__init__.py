"""Gridded land-cover analytics on Spark DataFrames."""
