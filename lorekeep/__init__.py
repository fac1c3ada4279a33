"""Semantic search, cited answers and corpus preparation as Spark jobs."""
