"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from paneltide.plans import desk_queries, document_queries, fundamental_queries, relational_queries, source_queries, strategy_queries, table_queries, template_queries, window_queries  # noqa: F401  (each module registers its queries)
from paneltide.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "n04_trend"
