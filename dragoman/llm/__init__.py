"""Operators for training-data preparation; nothing outside this folder and ``corpus_pipeline`` imports it."""
