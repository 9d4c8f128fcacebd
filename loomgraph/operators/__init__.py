"""Operators on DataFrames of files, imports, commits and documents."""
