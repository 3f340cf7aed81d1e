"""Column functions: scalars, distances, text analysis."""
