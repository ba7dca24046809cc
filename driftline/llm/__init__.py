"""Operators for training-data pipelines: filters, duplicate search, extraction and tokenizing."""
