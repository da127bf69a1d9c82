"""Operators for preparing training text: scans, language, search, shards, tokens, overlap, quality, copies."""
