"""Operators for large text corpora: filters, fingerprints, tokenizers and duplicate removal."""
