"""Operators for large training-data pipelines: text in, decisions, indexes and token files out.

Every operator is a function from DataFrames to DataFrames.  Nothing else in the library imports this package.
"""
