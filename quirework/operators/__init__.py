"""Operators of the engine: functions from DataFrame to DataFrame."""
