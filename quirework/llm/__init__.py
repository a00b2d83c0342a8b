"""Training-data operators: deduplication, filtering, scoring, mixing, packing.

Nothing outside this folder (but ``corpus_pipeline.py`` and the guarded import
in ``__spark_entry__.py``) imports it.
"""
