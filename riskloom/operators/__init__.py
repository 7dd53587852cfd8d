"""Operators: each module holds functions from DataFrame to DataFrame."""
