"""Operators for large training-data corpora: dedup, tokens, packing, extraction, language, search, toxicity."""
