"""Retrieval, graph and audit analytics over technical document collections, on Spark DataFrames."""
