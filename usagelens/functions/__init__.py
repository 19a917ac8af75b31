"""Column expressions: dates, text, null rules and value rules."""
