"""Operators for large text corpora: the steps of a training-data pipeline."""
