"""Traceability-graph analytics on PySpark."""
