"""Operators for preparing training text: deduplication, scoring, mixing, tokenising, vector search.

Nothing outside this subpackage imports it.
"""
