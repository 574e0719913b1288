"""Operators for building training corpora for language models.

Nothing else in the library imports this package.
"""
