"""Operators that prepare training data for language models.

Nothing outside this package imports it. ``registry`` holds the queries and their SQL.
"""
