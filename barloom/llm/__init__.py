"""Training-data operators: fingerprints, packing, mixing, toxicity, joins, sharding, scans and media columns.

Nothing outside this subpackage imports it.
"""
