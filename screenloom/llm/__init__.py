"""Operators for training-data pipelines over ``documents``, ``benchmark``, ``labels`` and ``conversations``.

Nothing else in the library imports this subpackage.
"""
