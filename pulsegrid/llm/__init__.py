"""Operators for training-data corpora: each module is one operator or a helper of several."""
