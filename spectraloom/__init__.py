"""Spectroscopic catalogue and change-detection jobs on Spark DataFrames."""
