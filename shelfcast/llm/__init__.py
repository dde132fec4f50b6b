"""Operators for preparing training text: formatting, filtering, deduplication, tokens, scoring."""
