"""Documents, commits, settings and question suites as DataFrames."""
