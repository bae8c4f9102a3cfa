"""Corpus preparation operators for language-model training data, one module each."""
