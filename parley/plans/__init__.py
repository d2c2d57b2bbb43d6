"""Whole flows: mixing corpora, building a draft vocabulary, making examples and batches."""
