"""Operators: functions from DataFrame to DataFrame over canonical logs."""
