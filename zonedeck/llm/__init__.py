"""Operators for training-data corpora: deduplication, filtering, classifiers, tokens and shards.

Nothing outside this package imports it.  Each operator module has its own docstring with the treatment of nulls,
empty and repeated rows; ``queries`` registers one query per operator.
"""
