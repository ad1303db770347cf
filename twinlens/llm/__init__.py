"""Operators for text corpora: tokens, search, near copies, filters, packing. Nothing else in the library imports them."""
