"""Column expressions and grouped-ranking building blocks."""
