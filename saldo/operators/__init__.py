"""Operators: functions from DataFrames to DataFrames. Nothing runs until the caller acts."""
