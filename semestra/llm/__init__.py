"""Operators for preparing training data: near-dedup, sharding, substring
dedup, tool-call linking, tokenisation, decontamination, embedding dedup,
toxicity, URL filtering and language identification.

Nothing else in the library imports this package.
"""
