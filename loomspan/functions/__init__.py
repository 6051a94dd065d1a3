"""Column expressions: text, markup and quality rules."""
