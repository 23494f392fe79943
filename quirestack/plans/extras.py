"""Exports, samples, paging by size, term order and version comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diff, windows
from ..tables import load
from .texts import passages

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT conv_id, string_agg('## ' || role || chr(10) || '> ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def notes_markdown(spark, d):
    block = F.concat(F.lit("## "), F.col("role"), F.lit("\n> "), F.col("text"))
    rows = load(spark, d, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("r"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda x: x["b"]), "\n\n").alias("markdown"), F.size("r").cast("long").alias("n"))


@query(r"""
SELECT p_partkey, '@misc{part' || p_partkey || ', title = {' || regexp_replace(p_name || ' ' || p_brand, '([&%#_])', '\\\1', 'g') || '}, note = {' || p_type || '}}' AS entry FROM part""")
def bibtex_records(spark, d):
    title = T.tex_escaped(F.concat_ws(" ", "p_name", "p_brand"))
    return load(spark, d, "part").select("p_partkey", F.concat(F.lit("@misc{part"), F.col("p_partkey"), F.lit(", title = {"), title, F.lit("}, note = {"), F.col("p_type"), F.lit("}}")).alias("entry"))


@query("""
WITH q AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7/' || lang || '/' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, lang FROM q WHERE r <= 5""")
def seeded_sample(spark, d):
    """Five documents of each language, by a seeded hash: the same for every layout of the input."""
    rows = load(spark, d, "documents").select("doc_id", "lang", F.md5(F.concat_ws("/", F.lit("7"), "lang", "doc_id").cast("binary")).alias("h"))
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 5").select("doc_id", "lang")


@query("""
WITH c AS (SELECT source, doc_id, sum(n_chars + 20) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS size FROM documents) SELECT source, doc_id, size::BIGINT AS size FROM c WHERE size <= 20000""")
def page_within_bytes(spark, d):
    docs = load(spark, d, "documents").select("source", "doc_id", (F.col("n_chars") + 20).alias("cost"))
    return windows.running_sum(docs, "source", "doc_id", "cost", "size").where("size <= 20000").select("source", "doc_id", "size")


@query("""
WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY f) AS number FROM f""")
def numbers_by_first_appearance(spark, d):
    first = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.select("user_id", "event_type", F.dense_rank().over(Window.partitionBy("user_id").orderBy("f")).alias("number"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
t AS (SELECT doc_id, p, contains(lower(line), 'ation') AS has, length(line) > 200 AS owner FROM l), o AS (SELECT doc_id, min(p) AS owner FROM t WHERE owner GROUP BY doc_id)
SELECT t.doc_id, count(*) AS early FROM t JOIN o ON t.doc_id = o.doc_id WHERE t.has AND t.p < o.owner GROUP BY t.doc_id""")
def terms_before_owner(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.contains(F.lower(x), F.lit("ation")).alias("has"), (F.length(x) > 200).alias("owner")))
    rows = load(spark, d, "documents").select("doc_id", lines.alias("x"))
    owner = F.array_position(F.transform("x", lambda x: x["owner"]), F.lit(True))
    early = F.size(F.filter(F.slice("x", 1, F.greatest(owner - 1, F.lit(0)).cast("int")), lambda x: x["has"]))
    return rows.select("doc_id", owner.alias("o"), early.cast("long").alias("early")).where("o > 0 AND early > 0").select("doc_id", "early")


@query("""
SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS days, CASE WHEN year(o_orderdate) = 1997 THEN strftime(o_orderdate, '%d %b') ELSE strftime(o_orderdate, '%d %b %Y') END AS label,
  least(8000, floor(round_even(o_totalprice, 0) / 4)::BIGINT) AS reserve FROM orders""")
def dates_and_reserves(spark, d):
    day = F.col("o_orderdate")
    label = F.when(F.year(day) == 1997, F.date_format(day, "dd MMM")).otherwise(F.date_format(day, "dd MMM yyyy"))
    return load(spark, d, "orders").select("o_orderkey", F.datediff(F.lit("2000-01-01").cast("date"), day).cast("long").alias("days"), label.alias("label"),
                                           F.least(F.lit(8000).cast("long"), F.floor(F.bround("o_totalprice") / 4)).alias("reserve"))


@query("""
SELECT doc_id, lang || ':' || source AS facet, sha256(lang || '/' || source || '/' || text) AS digest, lower(hex(source)) AS bytes FROM documents""")
def content_digests(spark, d):
    joined = F.concat_ws("/", "lang", "source", "text")
    return load(spark, d, "documents").select("doc_id", F.concat_ws(":", "lang", "source").alias("facet"), F.sha2(joined.cast("binary"), 256).alias("digest"), F.lower(F.hex(F.col("source").cast("binary"))).alias("bytes"))


@query("""
WITH a AS (SELECT list_sort(list(DISTINCT event_type)) AS a FROM events WHERE value > 100), b AS (SELECT list_sort(list(DISTINCT event_type)) AS b FROM events WHERE value < 0.1)
SELECT list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS unexpected FROM a, b""")
def field_difference(spark, d):
    rows = load(spark, d, "events")
    sets = rows.agg(F.collect_set(F.when(F.col("value") > 100, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") < 0.1, F.col("event_type"))).alias("b"))
    return sets.select(F.array_sort(F.array_except("a", "b")).alias("missing"), F.array_sort(F.array_except("b", "a")).alias("unexpected"))


@query()
def snapshot_diff_items(spark, d):
    lines = passages(load(spark, d, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("r"))
    old = lines.select("doc_id", F.transform("r", lambda x: x["line"]).alias("items"))
    new = lines.select("doc_id", F.transform(F.filter("r", lambda x: x["pos"] % 7 != 3), lambda x: F.when(x["pos"] % 5 == 1, F.upper(x["line"])).otherwise(x["line"])).alias("items"))
    return diff.snapshot_diff(old, new, ["doc_id"], "items")


@query("""
WITH v AS (SELECT conv_id AS k, turn AS ver, role AS line FROM conversations), c AS (SELECT k, ver, list(line) OVER (PARTITION BY k ORDER BY ver ROWS UNBOUNDED PRECEDING) AS lines FROM v), l AS (SELECT k, max(ver) AS last FROM v GROUP BY k)
SELECT c.k, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line, unnest((SELECT list(ver ORDER BY ver) FROM v WHERE v.k = c.k)) AS since FROM c JOIN l ON c.k = l.k AND c.ver = l.last""")
def blame_lines(spark, d):
    """DIF-03: a conversation's roles, a line added with every turn; versions are the conversation up to each turn."""
    w = Window.partitionBy("k").orderBy("ver").rowsBetween(Window.unboundedPreceding, 0)
    versions = load(spark, d, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("ver"), "role")
    versions = versions.select("k", "ver", F.transform(F.array_sort(F.collect_list(F.struct("ver", "role")).over(w)), lambda x: x["role"]).alias("lines"))
    return diff.blame(versions, ["k"], "ver", "lines")
