"""Relational building blocks: each takes and returns DataFrames."""
