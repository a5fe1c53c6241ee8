"""Operators for preparing training text at scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it, so it
can be removed without touching the rest of the library.
"""
