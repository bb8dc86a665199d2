"""Dataflow operators: DataFrames in, DataFrames out. Rankings are (query_id, rank, chunk_id, score) with ranks from 1."""
