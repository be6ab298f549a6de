"""Spark-native analytics over corpora of saved SQL queries.

Operators are plain functions from DataFrames to DataFrames; nothing runs until
the caller asks for a result.
"""
