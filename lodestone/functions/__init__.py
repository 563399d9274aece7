"""Column expressions and pure-Python source analysis."""
