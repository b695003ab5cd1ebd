"""Column expressions: text matching, JSON lines, value formatting."""
