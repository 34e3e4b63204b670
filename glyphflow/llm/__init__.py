"""Operators for preparing large text corpora.

Nothing outside this folder imports it.  ``queries()`` and ``oracle_sql()`` in
:mod:`glyphflow.llm.registry` are what ``__spark_entry__.py`` adds when the folder exists.
"""
