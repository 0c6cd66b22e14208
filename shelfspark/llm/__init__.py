"""Operators for preparing training text: filters, deduplication, mixing, search."""
