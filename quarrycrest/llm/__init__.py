"""Operators for preparing language-model training text.

Nothing outside this folder imports it.  ``queries()`` and ``oracle_sql()``
are what ``__spark_entry__`` adds when the folder, with the packages it needs, is
there: they are imported here, so that a missing one shows at once.
"""

from __future__ import annotations

from quarrycrest.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
