"""Column expressions and small shared helpers."""
