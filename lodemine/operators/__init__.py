"""Relational operators of the mining pipeline."""
