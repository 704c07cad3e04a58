"""Operators for preparing training text: deduplication, packing, quality, toxicity, licences, search and extraction."""
