"""Multimodal creator search on Spark DataFrames."""
