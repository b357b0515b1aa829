"""Column functions: geometry, labels, affinities."""
