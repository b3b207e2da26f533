"""Operators for corpora of training text. Nothing outside this package imports it."""
