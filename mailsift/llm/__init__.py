"""Operators for preparing training text: packing, filters, sharding, duplicates and tokens.

Nothing else in the library imports this subpackage.
"""
