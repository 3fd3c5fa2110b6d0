"""Operators for preparing training data: filtering, deduplication, packing, sharding, tokenizing and extraction.

Nothing outside this subpackage imports it. ``queries.py`` registers one query per operator.
"""
