"""Whole jobs: chains of operators over all stations, variables and forecast hours at once."""
