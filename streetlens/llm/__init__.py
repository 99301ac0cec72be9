"""Operators for training-data pipelines over large text corpora.

Nothing else in the library imports this subpackage.
"""
