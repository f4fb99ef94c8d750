"""Training-data operators: deduplication, filtering, search, tokens and packing.

Nothing outside this subpackage imports it.
"""
