"""Operators for training-data pipelines: scoring, rules, counts, mixing, joins, search and token files."""
