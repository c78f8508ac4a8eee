"""Operators of a training-data pipeline: scoring, deduplication, decontamination,
tokenisation, chat formatting and secret scans over Spark DataFrames.

Nothing outside this subpackage imports it.
"""
