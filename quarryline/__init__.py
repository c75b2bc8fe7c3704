"""Quarryline: text-corpus analytics on Spark DataFrames."""
