"""Operators over DataFrames of documents, requests, graphs, logs and sources."""
