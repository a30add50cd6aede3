"""Column expressions: constants, text, paths, measures."""
