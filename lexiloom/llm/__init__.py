"""Training-data operators: dedup, scoring, packing, mixing, search and sharding.

Nothing outside this subpackage imports it.
"""
