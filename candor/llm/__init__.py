"""Operators for large text corpora: search, language, duplicates, chat data, packing, mixing, tokens, secrets."""
