"""Column functions: vectors, text, guard-output parsers."""
