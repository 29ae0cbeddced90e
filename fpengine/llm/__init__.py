"""Operators of a training-data pipeline (toxicity, LM scoring, PII, near-duplicates, mixing,
tokenising). Nothing outside this package imports it."""
