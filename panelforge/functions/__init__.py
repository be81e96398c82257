"""Column expressions: missing values, indices, labels, bins."""
