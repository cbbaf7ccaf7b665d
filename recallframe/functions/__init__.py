"""Column functions: text, time, hashes, numbers."""
