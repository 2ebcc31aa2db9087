"""Training-data operators: dedup, search, packing, scoring, mixing, sharding.

Nothing else in the package imports this subpackage.
"""
