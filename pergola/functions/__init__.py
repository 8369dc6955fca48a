"""Column expressions: text, paths, hashes, prices, dates."""
