"""Readers and writers (files, key-value table semantics) and the academic
views derived from the driver's tables."""
