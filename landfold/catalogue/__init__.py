"""Named queries over the driver tables, each with the SQL that must agree with it.

A query is a function of ``Tables`` (derived views over one data folder). Its
oracle is written as one SELECT over the same view names; the view definitions
are put in front of it as common table expressions.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from landfold.views import VIEW_ORDER, Tables, duck_view

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "coordinates", "predicates", "spatial", "linkage", "raster", "summaries",
    "ordering", "selection", "sets", "scalars", "hierarchy", "mesh", "audits",
    "telemetry", "exchange", "registry", "roads", "bodies", "coverage",
)


def query(name: str, oracle: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn

    return add


def with_views(sql: str) -> str:
    """Put the definitions of every view the SQL names in front of it."""
    body = sql.strip().rstrip(";")
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEW_ORDER:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(duck_view(name))

    visit(body)
    parts = [f"{name} AS ({duck_view(name).strip()})" for name in VIEW_ORDER if name in needed]
    head = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if head:
        return "WITH RECURSIVE " + ",\n".join([*parts, body[head.end():]])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


@cache
def load_all() -> None:
    for module in MODULES:
        try:
            importlib.import_module(f"landfold.catalogue.{module}")
        except ModuleNotFoundError as missing:
            if missing.name != f"landfold.catalogue.{module}":
                raise


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()

    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def oracles() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
