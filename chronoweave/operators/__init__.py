"""Operators over event graphs."""
