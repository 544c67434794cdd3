"""Operators for training-data pipelines over the text tables.

Nothing outside this subpackage imports it.
"""
