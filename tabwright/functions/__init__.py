"""Column expressions: text, numbers, dates and units."""
