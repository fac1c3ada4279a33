"""Column functions: text, patterns, vectors."""
