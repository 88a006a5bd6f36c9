"""Operators for large training-data pipelines (documents, pages, URLs)."""
