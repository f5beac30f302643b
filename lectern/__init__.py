"""Lectern: document analytics on Spark DataFrames."""
