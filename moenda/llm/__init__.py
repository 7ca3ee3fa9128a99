"""Operators for large training-data pipelines: tokens, pages, duplicates, packing, mixing."""
