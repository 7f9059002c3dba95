"""Corpus operators: search, packing, scoring, tokenising, extraction and deduplication."""
