"""The registry of queries over the star schema: a name, an operator, and its oracle SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumlake.plans import star

_REGISTERED: dict[str, tuple[Callable[[star.Star], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, tables: bool = True):
    """Registers an operator over a Star. sql follows the star's common tables unless tables is False."""

    def register(f: Callable[[star.Star], DataFrame]):
        assert name not in _REGISTERED, name
        _REGISTERED[name] = (f, sql and (star.SQL + sql if tables else sql))
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(star.stored(spark, sf_dir))) for name, (f, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql}
