"""Column expressions: labels and scalars."""
