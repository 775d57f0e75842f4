"""Operators for preparing training text: duplicates, filters, mixing, packing, token files, scoring.

Nothing outside this subpackage imports it.
"""
