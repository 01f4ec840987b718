"""Operators for preparing language-model training data. Nothing outside this package imports it."""
