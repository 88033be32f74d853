"""Relational operators: schedule analytics, link graphs, relevance search, ingest and validation."""
