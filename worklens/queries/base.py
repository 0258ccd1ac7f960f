"""Registry of the queries over the given tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from worklens.functions.text import WS

Build = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Build, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; ``sql`` is the DuckDB statement with the same result."""

    def register(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (build, sql)
        return build

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@dataclass(frozen=True)
class Proxy:
    """A table of the data model, derived from a given table.

    The expressions are plain SQL that Spark and DuckDB read alike, so a query
    and its SQL equivalent start from the same rows. ``where`` leaves rows out only where
    their absence is what a query shows: joins and checks of what is not there.
    """

    source: str
    columns: dict[str, str]
    where: str | None = None

    @property
    def whole(self) -> "Proxy":
        """The same table without its condition, for queries that need no missing rows."""
        return Proxy(self.source, self.columns)

    def df(self, spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, self.source)
        if self.where:
            rows = rows.filter(self.where)
        return rows.selectExpr(*[f"{expr} as {name}" for name, expr in self.columns.items()])

    @property
    def sql(self) -> str:
        listed = ", ".join(f"{expr} as {name}" for name, expr in self.columns.items())
        condition = f" where {self.where}" if self.where else ""
        return f"(select {listed} from {self.source}{condition})"


def stamp(c: Column | str) -> Column:
    """Timestamp as text, the same in both engines."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def sql_strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{WS}+|{WS}+\z', '', 'g')"


def sql_collapse(expr: str) -> str:
    return rf"regexp_replace({sql_strip(expr)}, '{WS}+', ' ', 'g')"


def sql_limited(expr: str, n: int) -> str:
    s = sql_strip(expr)
    return f"case when length({s}) > {n} then substring({s}, 1, {n}) || '...' else {s} end"
