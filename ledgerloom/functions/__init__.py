"""Column expressions: numbers, text, dates, similarity."""
