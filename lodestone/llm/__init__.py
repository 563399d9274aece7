"""Operators of a training-data pipeline: cleaning, deduplication, scoring and tokenisation.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
