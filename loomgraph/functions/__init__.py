"""Column functions: paths, source text, comments, redaction."""
