"""Operators of indexing, retrieval, answering, evaluation and leak scanning."""
