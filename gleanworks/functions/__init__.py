"""Column expressions and small text helpers that the operators share."""
