"""Training-data operators (scans, filters, dedup, tokenizing, search, classification).

Nothing outside this subpackage imports it, so it can be removed without touching the rest.
"""
