"""Composed queries: what a user of the package calls."""
