"""Whole runs: building an index, asking it, scoring it, scanning for leaks."""
