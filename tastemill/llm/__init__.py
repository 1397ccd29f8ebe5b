"""Operators on text corpora for training-data pipelines, and their registered queries.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
