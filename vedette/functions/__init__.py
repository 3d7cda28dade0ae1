"""Column expressions (no Python per row)."""
