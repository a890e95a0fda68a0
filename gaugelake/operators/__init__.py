"""Operators: functions from DataFrames to DataFrames. None of them collects rows or holds a session."""
