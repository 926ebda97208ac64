"""Spark-first engine for corpora of hierarchical, cross-citing documents."""
