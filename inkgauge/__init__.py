"""Corpus-scale content audit as Spark DataFrames."""
