"""Operators over change history: aggregation, coalescing, transaction fate, replay, links, write path."""
