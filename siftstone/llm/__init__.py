"""Operators for training-data pipelines: licences, language models, packing, archives, deduplication.

Nothing else in the library imports this subpackage; it imports nothing of the rest.
"""
