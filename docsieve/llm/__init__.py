"""Corpus preparation for language models: scoring, filtering, deduplication, search and encoding."""
