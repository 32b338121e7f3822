"""Structured Streaming forms of operators that need no more than the row at hand."""
