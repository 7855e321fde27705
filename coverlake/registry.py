"""Query registry: name -> (spark callable, DuckDB oracle SQL or None).

``__spark_entry__`` exposes these.  Each callable takes (spark, sf_dir) and
reads whole driver tables (through the fixture views).  Computed columns
carry the same aliases in Spark and in SQL; doubles that come out of
floating-point sums are rounded to 9 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            from coverlake.oracles import with_fixtures
            ORACLES[name] = with_fixtures(sql)
        return fn
    return deco


def load_all():
    """Import the modules that register queries."""
    import coverlake.queries  # noqa: F401
    return QUERIES, ORACLES
