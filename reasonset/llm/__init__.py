"""Operators for preparing training data: archives, pages, texts, tokens, duplicates and packing."""
