"""Column expressions: everything here is built from Catalyst expressions."""
