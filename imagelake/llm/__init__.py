"""Operators for preparing training text: deduplication, filtering, encoding, packing, sharding.

Nothing else in the library imports this subpackage.
"""
