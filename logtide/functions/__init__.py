"""Column expressions: parsing, levels, redaction."""
