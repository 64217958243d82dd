"""Operators for preparing training text: deduplication, filtering, scoring, tokens and mixing.

Nothing outside this subpackage imports it.
"""
