"""Column functions: distances, codes, and their SQL names."""
