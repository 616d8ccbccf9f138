"""Operators for preparing large text corpora: filtering, deduplication, scoring, mixing, extraction."""
