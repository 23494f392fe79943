"""Nested values of any shape: leaves with their paths, the first difference of two values, records of search services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stored
from .nested import items, kind, member, string

# The form of identifiers that records must have.
BASE_ID = r"^(\d{4}\.\d{4,5}|[A-Za-z][A-Za-z.\-]*/\d{7})$"


def leaves(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, path, order, value): every value that holds no others, at any depth; path as $.a[2].b, order an array that sorts as they stand.

    value: a VARIANT.  Empty objects and arrays are leaves, members stand in the order of their names.  Each round opens one level
    of what is still nested, wherever it lies, so rounds are as many as the deepest value has levels.
    """
    steps = F.array().cast("array<string>")
    rows = df.where(F.col(value).isNotNull()).select(*key, F.lit("$").alias("path"), steps.alias("order"), F.col(value).alias("value"))
    out = None
    while True:
        shape = kind(F.col("value"))
        size = F.when(shape == "ARRAY", F.size(items(F.col("value")))).when(shape == "OBJECT", F.size(F.try_variant_get("value", "$", "map<string,variant>"))).otherwise(0)
        rows = stored(rows.withColumn("shape", shape).withColumn("nested", size > 0), "level")
        flat = rows.where("NOT nested").select(*key, "path", "order", "value")
        out = flat if out is None else out.unionByName(flat)
        if rows.where("nested").isEmpty():
            return out
        inner = rows.where("nested AND shape = 'ARRAY'").select(*key, "path", "order", F.posexplode(items(F.col("value"))).alias("_i", "_v"))
        inner = inner.select(*key, F.concat("path", F.lit("["), F.col("_i").cast("string"), F.lit("]")).alias("path"), F.concat("order", F.array(F.lpad(F.col("_i").cast("string"), 10, "0"))).alias("order"), F.col("_v").alias("value"))
        named = rows.where("nested AND shape = 'OBJECT'").select(*key, "path", "order", F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("_m", "_v"))
        named = named.select(*key, F.concat("path", F.lit("."), F.col("_m")).alias("path"), F.concat("order", F.array("_m")).alias("order"), F.col("_v").alias("value"))
        rows = inner.unionByName(named)


def first_difference(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, path, old, new) of the first leaf, in order, that two nested values don't share, as JSON, null where one has no such leaf.

    Keys that only one side has differ at '$' of that side's first leaf; equal values have no row.
    """
    side = lambda df, name: leaves(df, key, value).select(*key, "path", "order", F.to_json("value").alias(name))
    both = side(old, "old").join(side(new, "new"), [*key, "path", "order"], "full_outer").where("NOT old <=> new")
    first = both.groupBy(*key).agg(F.min_by(F.struct("path", "old", "new"), F.struct("order", "path")).alias("d"))
    return first.select(*key, "d.*")


def _words(v: Column, name: str) -> Column:
    return F.when(kind(member(v, name)) == "STRING", T.squash(string(v, name))).otherwise("")


def base_id(x: Column) -> Column:
    """An identifier without its version, null if it isn't one."""
    base = T.base_id(x)
    return F.when(base.rlike(BASE_ID), base)


def search_rows(answers: DataFrame, key: list[str], body: str, limit: int = 20) -> DataFrame:
    """(key, place, arxiv_id, title, authors, year, abstract, source): valid records of search answers, the first `limit` of each.

    body: JSON of either service, told by where its records stand: `data` with externalIds.ArXiv and authors by name, or `results` with
    arxiv_id, authors as strings and a date.  Records without a valid identifier are left out, as are values of other kinds;
    text that isn't JSON gives no record.
    """
    v = F.try_parse_json(body)
    records = F.transform(items(v, "data"), lambda r: F.struct(F.lit("data").alias("source"), r.alias("r")))
    records = F.concat(records, F.transform(items(v, "results"), lambda r: F.struct(F.lit("results").alias("source"), r.alias("r"))))
    rows = answers.select(*key, F.posexplode(records).alias("at", "x")).select(*key, "at", "x.source", "x.r")
    r, first = F.col("r"), F.col("source") == "data"
    names = F.when(first, F.transform(items(r, "authors"), lambda a: string(a, "name"))).otherwise(F.transform(items(r, "authors"), lambda a: T.squash(string(a))))
    names = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    dated = F.regexp_extract(F.coalesce(string(r, "published"), F.lit("")), r"^(\d{4})", 1)
    year = F.when(first, F.try_variant_get("r", "$.year", "int")).otherwise(F.nullif(dated, F.lit("")).cast("int"))
    made = rows.select(
        *key, "at", base_id(F.when(first, string(r, "externalIds.ArXiv")).otherwise(string(r, "arxiv_id"))).alias("arxiv_id"), _words(r, "title").alias("title"), names.alias("authors"), year.alias("year"),
        F.when(first, _words(r, "abstract")).otherwise("").alias("abstract"), "source",
    ).where("arxiv_id IS NOT NULL")
    # An answer is one service's page, so its records are few and counted where they are.
    each = made.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct(*[c for c in made.columns if c not in key]))), 1, limit).alias("x"))
    each = each.select(*key, F.posexplode("x").alias("place", "x"))
    return each.select(*key, "place", *[f"x.{c}" for c in made.columns if c not in (*key, "at")])


def official_code(answers: DataFrame, key: list[str], body: str) -> DataFrame:
    """(key, url, stars) of the first official repository in an answer; others have no row."""
    own = F.filter(items(F.try_parse_json(body), "repositories"), lambda r: (kind(member(r, "is_official")) == "BOOLEAN") & F.try_variant_get(r, "$.is_official", "boolean") & string(r, "url").isNotNull())
    rows = answers.select(*key, F.get(own, 0).alias("r")).where("r IS NOT NULL")
    return rows.select(*key, string(F.col("r"), "url").alias("url"), F.coalesce(F.try_variant_get("r", "$.num_stars", "int"), F.lit(0)).alias("stars"))
