"""Operators: functions from DataFrame to DataFrame over series keyed by dataset and channel."""
