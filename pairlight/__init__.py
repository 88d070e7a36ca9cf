"""Paired-output audit engine on Spark DataFrames."""
