"""All named queries of the library and their SQL twins."""

from __future__ import annotations

from loomery.plans import article_queries, clause_queries, context_queries, extraction_queries, incremental_queries, merge_queries, metadata_queries, nested_queries, page_queries, predicate_queries, reading_queries, result_queries, rollup_queries, search_queries, stream_queries, text_queries, title_queries  # noqa: F401
from loomery.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
