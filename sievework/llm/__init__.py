"""Operators for preparing training data: duplicates, quality, mixing, packing.

Nothing outside this subpackage imports it.
"""
