"""Query registry shared by the driver entry point, the tests and the bench."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldlens.plans.tables import LOGICAL_SQL, Tables
from fieldlens.session import ship_package


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under its function name; ``covers`` lists inventory ids."""

    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), build, with_tables(sql) if sql else None)
        return build

    return register


def with_tables(sql: str) -> str:
    """Put the logical tables that ``sql`` mentions in front of it as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in LOGICAL_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = [f"{name} AS ({LOGICAL_SQL[name]})" for name in needed]
    body = sql.strip()
    if not ctes:
        return body
    recursive = bool(re.match(r"(?i)with\s+recursive\b", body))
    head = "WITH RECURSIVE " if recursive else "WITH "
    own = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if own:
        return head + ",\n".join(ctes) + ",\n" + body[own.end():]
    return head + ",\n".join(ctes) + "\n" + body


def r6(expr: str) -> str:
    """SQL text of a value rounded to six decimals, with negative zero removed."""
    return f"(round({expr}, 6) + 0.0)"


def r9(expr: str) -> str:
    """As ``r6`` with nine decimals, for quotients that can end exactly on a half at six."""
    return f"(round({expr}, 9) + 0.0)"
