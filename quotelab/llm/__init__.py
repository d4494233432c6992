"""Operators for large training-data pipelines: filtering, duplicates, packing, models, archives, search."""
