"""Distantly supervised web extraction and corpus processing on Spark DataFrames."""
