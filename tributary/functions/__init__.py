"""Column expressions: hashes and comparisons."""
