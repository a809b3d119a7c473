"""Operators for building training corpora: scoring, search, dedup, mixing, packing, sharding.

Nothing else in the package imports this subpackage.
"""
