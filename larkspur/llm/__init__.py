"""Training-data operators: deduplication, sharding, packing, quality, mixing and token output.

Nothing outside this subpackage imports it.
"""
