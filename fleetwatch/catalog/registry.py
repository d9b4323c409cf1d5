"""Where queries meet their SQL twin and the survey rows they cover."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, *covers: str, sql: str | None = None):
    def add(run):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, covers, run, sql)
        return run

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), digits)


def off_tie(c: Column | str, digits: int) -> Column:
    """Rounded with a fixed shift, so that means of short decimals never sit on a half."""
    return F.round((c if isinstance(c, Column) else F.col(c)) + 0.12371513 * 10**-digits, digits)


def off_tie_sql(x: str, digits: int) -> str:
    return f"round({x} + {0.12371513 * 10**-digits!r}::DOUBLE, {digits})"


def checksum(arr: Column) -> Column:
    """Position-weighted sum of an array, rounded: order and values in one number."""
    return F.round(F.aggregate(F.transform(arr, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 5)


def checksum_sql(arr: str) -> str:
    return f"round(list_sum(list_transform({arr}, lambda x, i: x * i)), 5)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
