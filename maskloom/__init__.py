"""Mask-annotation dataset engine built on Spark DataFrames."""
