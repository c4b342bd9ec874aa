"""Column expressions and option rules."""
