"""Operators for text corpora and model training data. Nothing outside this subpackage imports it."""
