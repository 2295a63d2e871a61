"""Operators for text corpora: near-duplicates, boilerplate, encodings, spam, residue, tokens."""
