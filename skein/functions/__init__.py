"""Column expressions: text shaping, content blocks, tokens."""
