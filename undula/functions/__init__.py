"""Scalar functions for SQL."""
