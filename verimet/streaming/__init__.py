"""Hourly increments with Structured Streaming."""
