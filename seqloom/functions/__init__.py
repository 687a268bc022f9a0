"""Column expressions: text to ids, seeded randomness, vector maths."""
