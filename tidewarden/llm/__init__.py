"""Operators for large training-data pipelines, one module for each.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, reads only the columns that it names, and runs on Spark's own
partitioning.
"""
