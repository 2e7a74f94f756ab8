"""Operators of a training-data pipeline over text corpora.

Nothing outside this folder (and the pipeline script beside the entry module)
imports it, so it can be removed without touching the rest of the library.
"""
