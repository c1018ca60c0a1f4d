"""Column expressions and series functions."""
