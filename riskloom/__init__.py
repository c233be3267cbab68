"""Corpus risk analytics on Spark DataFrames."""
