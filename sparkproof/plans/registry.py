"""Named queries and, where SQL can say the same on whole tables, their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkproof.sources.bindings import oracle_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = fn
        if sql is not None:
            # Patterns shared with Spark carry Java's Unicode case flag, which RE2 has on by default.
            text = oracle_text(sql).replace("(?iu)", "(?i)").replace("(?ius)", "(?is)")
            ORACLE[name] = text
        return fn

    return register
