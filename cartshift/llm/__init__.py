"""Operators for a training-data pipeline over ``documents``, ``pages`` and ``embeddings``.

Nothing else in the library imports this package; it can be removed as a whole.
"""
