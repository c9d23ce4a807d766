"""Retrieval, graph and corpus analytics as Spark operators: functions from DataFrames to a DataFrame."""
