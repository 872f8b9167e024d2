"""Similarity-graph analytics as declarative Spark plans."""
