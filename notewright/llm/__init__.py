"""Operators for text corpora: overlap, matching, normal form, splitting, tokens, mixing and sentences."""
