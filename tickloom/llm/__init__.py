"""Training-data operators: PII, near-dedup, quality, mixing, packing, sharding, search and licences.

Nothing outside this subpackage imports it.
"""
