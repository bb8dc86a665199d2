"""Structured Streaming over the append log. An extension: the batch plans don't need it."""
