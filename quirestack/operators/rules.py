"""Validation: a table of rules evaluated in one pass into rows of issues."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A record fails where the predicate doesn't hold; a null predicate counts as failed."""

    name: str
    path: str
    holds: Column
    message: Column | str = ""


def issues(df: DataFrame, key: list[str], rules: list[Rule]) -> DataFrame:
    """(key, rule, path, message) of every failure, not just the first."""
    def struct(r: Rule) -> Column:
        message = r.message if isinstance(r.message, Column) else F.lit(r.message)
        return F.struct(F.lit(r.name).alias("rule"), F.lit(r.path).alias("path"), message.alias("message"))

    found = F.array_compact(F.array(*[F.when(~F.coalesce(r.holds, F.lit(False)), struct(r)) for r in rules]))
    return df.select(*key, F.explode(found).alias("_i")).select(*key, "_i.*")


def symmetric_difference(a: Column, b: Column) -> Column:
    """Names missing and names unexpected."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


#: What DuckDB calls the functions that rule tables use.
_DUCK = {"regexp_like(": "regexp_matches(", "size(": "len(", "isnan(": "isnan(", "element_at(": "list_extract("}


def table(rows: list[tuple[str, str, str]]) -> list[Rule]:
    """Rules from (name, path, predicate in SQL); predicates stay portable, so a rule table reads the same everywhere."""
    return [Rule(name, path, F.expr(predicate)) for name, path, predicate in rows]


def table_sql(source: str, key: list[str], rows: list[tuple[str, str, str]]) -> str:
    """The issues of a rule table over a DuckDB relation, as (key, rule, path)."""
    def duck(x: str) -> str:
        for spark, name in _DUCK.items():
            x = x.replace(spark, name)
        return x

    keys = ", ".join(key)
    parts = [f"SELECT {keys}, '{name}' AS rule, '{path}' AS path FROM r WHERE NOT coalesce({duck(predicate)}, false)" for name, path, predicate in rows]
    return f"WITH r AS ({duck(source)}) " + " UNION ALL ".join(parts)


def _leaves(value, path: str):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}[{i}]")
    elif isinstance(value, str):
        yield {"path": path, "value": value}


def _all_leaves(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return list(_leaves(json.loads(text), "$")) if isinstance(text, str) else []
        except ValueError:
            return []

    return pd.Series([one(t) for t in texts], dtype=object)


def flattened(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, path, value) of every string in a JSON column; text that isn't JSON has none."""
    leaves = F.pandas_udf(_all_leaves, "array<struct<path:string,value:string>>")(F.col(column))
    return df.select(*key, F.explode(leaves).alias("l")).select(*key, "l.*")
