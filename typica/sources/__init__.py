"""Corpus loaders and the response cache."""
