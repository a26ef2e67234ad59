"""Column expressions and small scalar helpers."""
