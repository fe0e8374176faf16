"""Column expressions and distributed ranking helpers."""
