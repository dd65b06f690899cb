"""Operators of a training-data pipeline: token files, counts, quality, near duplicates, search, packing, mixing.

Nothing else in the library imports this package. ``queries.py`` binds the operators to the
test tables.
"""
