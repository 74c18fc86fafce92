"""Disaster-impact analytics on Spark: rasters, road graphs, facts and rankings as DataFrames."""
