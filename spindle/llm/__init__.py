"""Operators for training-data corpora: text, URLs, conversations and vectors."""
