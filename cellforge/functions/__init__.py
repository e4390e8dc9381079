"""Column expressions on shape masks."""
