"""Column expressions: text rules and overlap scores."""
