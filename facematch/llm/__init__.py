"""Training-data operators: dedup, quality, packing, sharding, tokens, search.

Nothing outside this subpackage imports it.
"""
