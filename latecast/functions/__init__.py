"""Column expressions: week arithmetic, strata, text, numeric helpers."""
