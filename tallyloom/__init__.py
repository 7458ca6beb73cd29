"""Tabular profiling, keyed run logs, retrieval, text and model operators on PySpark."""
