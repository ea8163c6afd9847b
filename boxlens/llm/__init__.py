"""Operators for large-scale training-data preparation on Spark.

Every module holds one operator with a general interface (DataFrames in,
DataFrames out); ``queries`` derives the registered ``opN_<name>`` queries from
them and ``sql`` holds the DuckDB texts. Nothing else in the library imports
this subpackage.
"""
