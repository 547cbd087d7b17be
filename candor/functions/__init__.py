"""Column expressions and reusable DataFrame building blocks."""
