"""Readers, series views and writers."""
