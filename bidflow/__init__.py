"""Freight-bid pipeline and analytics on Spark DataFrames."""
