"""Column expressions: text, patterns, paths and JSON text."""
