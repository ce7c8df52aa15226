"""Column functions: text normalisation, metrics and hashing."""
