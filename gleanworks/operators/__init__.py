"""Operators over record deliveries: integrity, census, code lists, derivations, scoring, ranking and review."""
