"""Operators for preparing training data: de-duplication, language, tokens, packing, scoring, chat.

Nothing outside this subpackage imports it. ``catalog.queries()`` and ``catalog.oracle_sql()`` list what
``__spark_entry__.py`` registers.
"""
