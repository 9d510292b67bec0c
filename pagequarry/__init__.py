"""Metadata extraction and library planning as Spark DataFrames."""
