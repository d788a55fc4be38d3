"""Embedding ingestion, vector collections and semantic search as Spark jobs."""

__version__ = "0.1.0"
