"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this package imports it. Each module holds one operator with a
general interface; :mod:`hearth.llm.queries` registers the thin queries.
"""
