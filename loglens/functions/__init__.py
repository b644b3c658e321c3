"""Scalar helpers: each returns a built-in Column expression."""
