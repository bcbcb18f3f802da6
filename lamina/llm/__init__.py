"""Operators for preparing training corpora: deduplication, filters, packing, scoring and sharding.

Nothing else in the library imports this subpackage.
"""
