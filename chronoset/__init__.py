"""Bitemporal facts, replicated sets and training-data operators as Spark DataFrames."""
