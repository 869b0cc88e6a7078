"""Column functions: keys, row text, hashes."""
