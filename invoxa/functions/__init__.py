"""Column -> Column building blocks (regex families, parsers, codes, JSON)."""
