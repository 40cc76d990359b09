"""Column functions: text, probabilities, vectors, hashing and formatting."""
