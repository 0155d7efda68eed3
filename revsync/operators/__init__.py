"""Operators: functions from DataFrames to DataFrames, lazy, with no actions inside."""
