"""Operators of a training-data pipeline: scans, joins, scoring and packing of text corpora.

Every operator takes and returns DataFrames, reads whole texts, and keeps its own
intermediate tables in the shared folder named by ``spark.checkpoint.dir``.
"""
