"""Corpus-preparation operators for training data.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
