"""Column expressions: calendar parts, money arithmetic, tail probabilities."""
