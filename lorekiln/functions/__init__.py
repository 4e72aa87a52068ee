"""Column functions: text, values, ranks."""
