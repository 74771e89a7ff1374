"""Operators for preparing large text corpora: deduplication, joins, search, scoring, packing."""
