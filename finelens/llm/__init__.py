"""Operators of a training-data pipeline: archives, dedup, PII, quality, tokens, packing.

Nothing else in the library imports this subpackage.  One module per
operator; ``queries`` registers the ``opN_<name>`` queries and their SQL.
"""
