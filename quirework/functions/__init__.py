"""Column expressions: text, patterns, predicates."""
