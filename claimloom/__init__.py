"""Claim and evidence analytics on Spark DataFrames."""
