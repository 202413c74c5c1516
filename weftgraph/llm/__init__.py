"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries.py`` holds the thin registered queries.
"""
