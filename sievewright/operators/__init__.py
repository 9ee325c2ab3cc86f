"""Data-quality operators: functions from DataFrames to DataFrames."""
