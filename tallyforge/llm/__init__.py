"""Operators of a training-data pipeline: dedup, tokens, quality, chat, search, extraction, packing.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
