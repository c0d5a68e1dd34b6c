"""Query plans over the driver's tables."""

from corpusloom.plans import label_queries, operator_queries, source_queries, table_queries, text_queries  # noqa: F401  (they register their queries)
from corpusloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
