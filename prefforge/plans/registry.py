"""Queries by name, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from prefforge.plans.fixtures import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, build: Callable, sql: str | None = None) -> None:
    """build takes get, a function from the name of a view or table to its frame."""
    QUERIES[key] = lambda spark, sf_dir: build(lambda name: view(spark, sf_dir, name))
    if sql is not None:
        SQL[key] = oracle(sql)


def scalar(key: str, source: str, ids: str, make: Callable[[], Column | dict[str, Column]], sql: str, where: str | None = None) -> None:
    """A query of the ids of a view and one expression (value) or several; sql is the select list that DuckDB needs."""

    def build(get):
        rows = get(source) if where is None else get(source).filter(where)
        made = make()
        made = made if isinstance(made, dict) else {"value": made}
        return rows.select(*ids.split(), *[c.alias(k) for k, c in made.items()])

    names = ", ".join(ids.split())
    register(key, build, f"SELECT {names}, {sql if ' AS ' in sql else sql + ' AS value'} FROM {{{source}}}" + (f" WHERE {where}" if where else ""))


def keep(key: str, source: str, ids: str, test: Callable[[], Column], sql: str) -> None:
    """A query of the ids of the rows of a view that pass a test."""
    register(key, lambda get: get(source).filter(test()).select(*ids.split()), f"SELECT {', '.join(ids.split())} FROM {{{source}}} WHERE {sql}")
