"""Column expressions: text folding, identifiers, markup, rights, places."""
