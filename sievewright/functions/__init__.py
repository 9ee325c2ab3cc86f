"""Column helpers: coercion, patterns, names, formatting, text parsing."""
