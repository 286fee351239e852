"""Column functions: SQL text, periods, coercion, JSON text, name similarity."""
