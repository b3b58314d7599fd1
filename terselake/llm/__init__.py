"""Operators for preparing large training corpora.

Nothing else in :mod:`terselake` imports this subpackage. Each module holds one operator with a
general interface; :mod:`terselake.llm.queries` holds the thin queries built on them.
"""
