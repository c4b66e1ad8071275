"""Operators that prepare text corpora for training language models.

Nothing outside this folder imports it; the queries are in ``queries.py``.
"""
