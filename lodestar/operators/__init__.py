"""Retrieval, interest, time-series, clustering and persistence operators on DataFrames."""
