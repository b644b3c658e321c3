"""Relational and analytic operators: functions from DataFrame to DataFrame."""
