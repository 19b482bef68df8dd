"""Operators for large text corpora: extraction, licences, tokens, quality, near and exact duplicates."""
