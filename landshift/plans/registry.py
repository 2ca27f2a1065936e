"""Registered queries: a Spark job and, where SQL can state it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.plans.chain import Chain, chain
from landshift.plans.oracle_chain import with_chain


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Chain], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(chain(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    """Register ``build(chain)`` under ``name``; ``ctes`` are the chain parts ``sql`` uses."""

    def register(build: Callable[[Chain], DataFrame]) -> Callable[[Chain], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, with_chain(sql.strip(), *ctes) if sql else None)
        return build

    return register


def r6(value) -> Column:
    """Compare floating-point results to six places."""
    return F.round(value, 6)


def stamp(value) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def joined(values, decimals: int | None = None) -> Column:
    """Array as text, so that both engines show it alike."""
    def show(v: Column) -> Column:
        return v.cast("string") if decimals is None else F.format_string(f"%.{decimals}f", v)

    return F.array_join(F.transform(values, show), ",")


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def sql_stamp(value: str) -> str:
    return STAMP.format(value)


def sql_list(value: str) -> str:
    return f"array_to_string({value}, ',')"
