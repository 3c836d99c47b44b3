"""Column functions: text, names, hashes, numbers."""
