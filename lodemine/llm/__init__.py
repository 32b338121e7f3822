"""Operators for training-data preparation. Nothing outside this subpackage imports it."""
