"""Exposure and policy analytics on Spark: every operator maps DataFrames to a DataFrame."""
