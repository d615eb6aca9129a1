"""Column expressions: text, vectors, hashes."""
