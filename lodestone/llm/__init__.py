"""Operators for large training-text corpora: cleaning, deduplication, scoring, search, tokens and packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
