"""Column expressions: missing values, text, hashes and exact aggregates."""
