"""Column expressions: URLs, text, numbers, content indicators, templates."""
