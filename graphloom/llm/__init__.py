"""Operators for preparing training data at scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
Every operator takes and returns DataFrames; see the modules for their
contracts, their handling of nulls, ties, repeated rows and empty tables.
"""
