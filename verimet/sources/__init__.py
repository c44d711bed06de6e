"""Readers and writers around Parquet, CSV and JSON."""
