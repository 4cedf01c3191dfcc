"""Column expressions: one row in, one value out, all inside generated code."""
