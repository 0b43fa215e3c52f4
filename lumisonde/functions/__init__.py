"""Column expressions and array functions."""
