"""Longitudinal price-record analytics on Spark DataFrames."""
