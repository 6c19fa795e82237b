"""Operators for training-data corpora: scoring, archives, language, tokens, overlap, copies and neighbours."""
