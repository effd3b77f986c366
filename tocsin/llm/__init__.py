"""Operators of a training-data pipeline over a ``documents`` table.

Nothing else in the package imports this subpackage; its queries are in
``tocsin.llm.queries``.
"""
