"""Readers and writers. Everything goes through Spark's own sources, so any store that Spark reads will do."""
