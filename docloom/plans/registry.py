"""All named queries of the library."""

from __future__ import annotations

from docloom.plans import base, cost, graph, jobs, linkage, pages, search, store, streams, tags, text  # noqa: F401 - registers


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
