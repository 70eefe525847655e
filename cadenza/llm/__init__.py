"""Corpus operators for training data. Nothing outside this package imports it."""
