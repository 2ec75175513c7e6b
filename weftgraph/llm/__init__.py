"""Training-data operators: scoring, deduplication, decontamination, tokenisation, extraction.

Nothing outside this subpackage imports it.
"""
