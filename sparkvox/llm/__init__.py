"""Operators of a training-data pipeline (mixing, scoring, deduplication,
language identification, quality rules, token files, archives, packing).

Nothing else in the library imports this subpackage."""
