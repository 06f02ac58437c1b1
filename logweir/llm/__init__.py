"""Operators for training-data pipelines, their queries and their SQL.

Nothing outside this subpackage imports it.
"""
