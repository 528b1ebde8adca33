"""Column expressions: sequences, coordinates and scores."""
