"""Operators for preparing training text: encoding, deduplication, packing, formatting.

Nothing else in the library imports this subpackage.
"""
