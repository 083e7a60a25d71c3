"""Column functions: hashing, box geometry, text, scores."""
