"""Tessera: design evidence from stored web-page captures, as Spark DataFrames."""
