"""Registry of runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a runner and, where the result is expressible, its SQL."""

    def register(runner: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = runner
        if sql is not None:
            ORACLES[name] = sql
        return runner

    return register


def with_ctes(ctes: dict[str, str], names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` clause of the named CTEs (in order) followed by the body."""
    parts = ",\n".join(f"{n} AS ({ctes[n]})" for n in names.split())
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    body = body.strip()
    if body.startswith(","):
        return f"{keyword} {parts}{body}"
    return f"{keyword} {parts}\n{body}"
