"""Operators for building training data: packing, sharding, near-duplicate
removal, decontamination, scoring and formatting.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it."""
