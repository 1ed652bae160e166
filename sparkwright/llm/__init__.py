"""Operators of a training-data pipeline: deduplication, mixing, sharding,
tokenisation, search, extraction and filtering over document tables.

Nothing else in the library imports this subpackage.
"""
