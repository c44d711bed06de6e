"""Column-level functions.  All are built-in expressions, so they stay in codegen."""
