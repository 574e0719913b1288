"""Column functions: time, geometry, numbers."""
