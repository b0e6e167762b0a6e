"""Consistency-aware analytics on Spark: constraints, annotations and queries that carry them."""
