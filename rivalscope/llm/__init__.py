"""Operators for preparing training text: near-duplicates, mixing, quality, lines, pieces, toxicity, search, shards, secrets."""
