"""Forecast verification and error-prediction features as Spark jobs.

Every operator is a function from DataFrame(s) to DataFrame, every scalar is a
function from Column to Column.  Nothing here starts a session or keeps state.
"""
