"""Operators for preparing training data: deduplication, search, filters, mixing, packing and sharding.

Nothing outside this subpackage imports it, except ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
