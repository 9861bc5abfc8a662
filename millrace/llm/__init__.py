"""Operators for preparing large text corpora for model training.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when the package is present.
"""
