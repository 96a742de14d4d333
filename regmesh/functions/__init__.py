"""Column expressions (built-in Catalyst functions only, no UDFs)."""
