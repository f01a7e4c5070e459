"""Types, operators and functions of expressions."""
