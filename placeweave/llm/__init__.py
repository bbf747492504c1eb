"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage imports it. ``queries()`` and
``oracle_sql()`` in :mod:`placeweave.llm.registry` list its queries.
"""
