"""Logical queries and how they become DataFrame plans."""
