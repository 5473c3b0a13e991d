"""Operators for preparing training text: filters, near-duplicates, tokens and packing."""
