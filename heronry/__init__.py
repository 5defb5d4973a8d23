"""Hybrid retrieval, evaluation and index maintenance as Spark plans."""
