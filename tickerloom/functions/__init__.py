"""Column expressions and distributed scan helpers."""
