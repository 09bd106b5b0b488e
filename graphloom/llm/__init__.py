"""Operators for preparing large text corpora (language ID, dedup, mixing, packing, PII ...)."""
