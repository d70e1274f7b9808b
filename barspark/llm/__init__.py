"""Operators of a training-data pipeline over documents and web pages.

Nothing outside this package imports it; ``registry`` holds its named queries.
"""
