"""Budgeted text compression and corpus preparation on Spark DataFrames."""
