"""Readers and writers.  Files are opened by Spark's own readers, so any store that Spark reads works."""
