"""Column expressions: tokenising and weighting."""
