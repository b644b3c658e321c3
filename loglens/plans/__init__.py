"""Composed queries and stages."""
