"""Whole jobs and the query catalogue."""
