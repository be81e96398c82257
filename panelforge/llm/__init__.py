"""Operators for preparing training text: tokens, extraction, duplicates, quality, mixing, packing."""
