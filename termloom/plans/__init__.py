"""Queries as trees, and their compilation to column expressions."""
