"""Column functions: geometry, vectors, strings."""
