"""Terrane: analytics over a research corpus as Spark DataFrames."""
