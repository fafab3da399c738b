"""Column expressions and small schema helpers."""
