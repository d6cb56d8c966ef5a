"""Operators for preparing training data: sharding, dedup, mixing, chat, secrets, BPE, search, language."""
