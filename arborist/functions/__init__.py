"""Column expressions and seeded draws."""
