"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``embeddings``.

Nothing outside this subpackage imports it.  ``queries.py`` holds the
registered queries; each operator module has a general interface (real texts,
spans, verdicts) from which its query derives the digest columns.
"""
