"""Column expressions and closing formulas."""
