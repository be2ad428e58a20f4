"""Column functions: distances and weights."""
