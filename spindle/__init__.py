"""Retrieval, chunking and conversation analytics as Spark DataFrame transforms."""
