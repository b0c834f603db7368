"""Recommendation and tabular scoring built on Spark DataFrames and Spark ML."""
