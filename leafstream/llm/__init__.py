"""Training-data operators: mixing, quality rules, media columns, packing, licence and secret
scans, chat formatting, near-duplicates, token attribution and page text.

Nothing else in the library imports this subpackage.  Every module states its edge-case
results (nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns).
"""
