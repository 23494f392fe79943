"""List queries: summaries, searches, facets, top-k and pages.

Customers stand for papers, orders for jobs, events for the reading log.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import windows as W
from ..tables import load

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT c.c_custkey, c.c_name, n.n_name,
  EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AS has_pending,
  (SELECT min(o_orderdate) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS added_at,
  (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_jobs
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def library_summary(spark, d):
    jobs = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.bool_or(F.col("o_orderstatus") == "P").alias("p"),
        F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("added_at"),
        F.count(F.lit(1)).alias("n"),
    )
    nation = load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey").join(jobs, "c_custkey", "left").join(nation, "c_nationkey", "left")
    return rows.select("c_custkey", "c_name", "n_name", F.coalesce("p", F.lit(False)).alias("has_pending"), "added_at", F.coalesce("n", F.lit(0)).cast("long").alias("n_jobs"))


@query("""
SELECT p_partkey, p_name, p_brand FROM part
WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')""")
def library_search_all_words(spark, d):
    part = load(spark, d, "part")
    hay = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return part.where(T.all_words_in(hay, "Red  BRAND#1")).select("p_partkey", "p_name", "p_brand")


@query("""
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id),
states AS (SELECT unnest(['new','view','click','purchase','signup','error']) AS state),
each AS (SELECT coalesce(l.state, 'new') AS state FROM customer c LEFT JOIN last l ON c.c_custkey = l.user_id)
SELECT s.state AS state, count(e.state) AS n, (SELECT count(*) FROM each) AS total FROM states s LEFT JOIN each e ON s.state = e.state GROUP BY s.state""")
def reading_state_counts(spark, d):
    states = ["new", "view", "click", "purchase", "signup", "error"]
    last = load(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", "event_id").alias("state"))
    each = load(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left").select(F.coalesce("state", F.lit("new")).alias("state"))
    counts = each.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in states])
    rows = F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in states])
    return counts.select("total", F.explode(rows).alias("r")).select("r.state", "r.n", "total")


def _ranked(name: str, order: str):
    return f"SELECT o_orderkey, {name} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS {name} FROM orders) WHERE {name} <= 50"


@query(_ranked("place", "o_orderdate DESC, o_orderkey DESC"))
def sort_added(spark, d):
    top = load(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("place"))


@query("""SELECT p_partkey, p_name, place FROM (SELECT *, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part) WHERE place <= 50""")
def sort_title(spark, d):
    keys = [F.lower("p_name"), F.col("p_partkey")]
    top = load(spark, d, "part").select("p_partkey", "p_name").orderBy(*keys).limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*keys)))


@query(_ranked("place", "year(o_orderdate) * 100 + month(o_orderdate) DESC, o_orderkey"))
def sort_published(spark, d):
    keys = [F.desc("k"), F.asc("o_orderkey")]
    top = load(spark, d, "orders").select("o_orderkey", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("k")).orderBy(*keys).limit(50)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(*keys)).alias("place"))


def _opened(spark, d):
    reading = load(spark, d, "events").where("event_type = 'view'")
    return reading.groupBy("user_id").agg(F.max("ts").alias("opened_at")).orderBy(F.desc("opened_at"), "user_id").limit(3)


@query("SELECT user_id, max(ts) AS opened_at FROM events WHERE event_type = 'view' GROUP BY user_id ORDER BY opened_at DESC, user_id LIMIT 3")
def home_continue_top3(spark, d):
    return _opened(spark, d)


@query("""
WITH c AS (SELECT user_id FROM (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'view' GROUP BY user_id ORDER BY m DESC, user_id LIMIT 3))
SELECT user_id, min(ts) AS added_at FROM events WHERE user_id NOT IN (SELECT user_id FROM c) GROUP BY user_id ORDER BY added_at DESC, user_id LIMIT 5""")
def home_recent_excluding(spark, d):
    added = load(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("added_at"))
    return added.join(_opened(spark, d).select("user_id"), "user_id", "left_anti").orderBy(F.desc("added_at"), "user_id").limit(5)


@query("""
SELECT event_id, event_type FROM events WHERE event_type = 'signup'
UNION ALL (SELECT event_id, event_type FROM events WHERE event_type <> 'signup' ORDER BY ts DESC, event_id DESC LIMIT 100)""")
def recent_jobs_active_union(spark, d):
    jobs = load(spark, d, "events").select("event_id", "event_type", "ts")
    done = jobs.where("event_type <> 'signup'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return jobs.where("event_type = 'signup'").unionByName(done).select("event_id", "event_type")


@query("""
SELECT e.event_id FROM events e WHERE e.event_type = 'error' AND (EXISTS (
  SELECT 1 FROM events n WHERE n.event_type = e.event_type AND n.props = e.props AND n.user_id = e.user_id AND n.ts > e.ts)
  OR NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id))""")
def stale_jobs(spark, d):
    jobs = load(spark, d, "events").where("event_type = 'error'")
    newest = F.max("ts").over(Window.partitionBy("user_id", "props"))
    known = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    marked = jobs.withColumn("newest", newest).join(known, "user_id", "left")
    return marked.where((F.col("newest") > F.col("ts")) | F.col("known").isNull()).select("event_id")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'signup') AS active, min(event_id) FILTER (event_type = 'signup') AS first_active,
  CASE WHEN count(*) FILTER (event_type = 'signup') = 0 THEN count(*) FILTER (event_type = 'error') ELSE 0 END AS unseen_failed
FROM events GROUP BY user_id""")
def activity_rollup(spark, d):
    up, bad = F.col("event_type") == "signup", F.col("event_type") == "error"
    return load(spark, d, "events").groupBy("user_id").agg(
        F.count_if(up).alias("active"), F.min(F.when(up, F.col("event_id"))).alias("first_active"), F.when(F.count_if(up) == 0, F.count_if(bad)).otherwise(F.lit(0)).cast("long").alias("unseen_failed")
    )


@query("""
WITH local AS (SELECT doc_id, lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) AS k FROM documents WHERE source IN ('src1','src2')),
remote AS (SELECT doc_id, lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) AS k FROM documents WHERE source IN ('src3','src4'))
(SELECT doc_id, 'local' AS origin FROM local ORDER BY doc_id LIMIT 5)
UNION ALL (SELECT doc_id, 'remote' AS origin FROM remote WHERE k NOT IN (SELECT k FROM local) ORDER BY doc_id LIMIT 20)""")
def search_rows_dedup(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "source", T.fingerprint(F.col("text")).alias("k"))
    local, remote = rows.where(F.col("source").isin("src1", "src2")), rows.where(F.col("source").isin("src3", "src4"))
    fresh = remote.join(local.select("k"), "k", "left_anti")
    top = local.orderBy("doc_id").limit(5).select("doc_id", F.lit("local").alias("origin"))
    return top.unionByName(fresh.orderBy("doc_id").limit(20).select("doc_id", F.lit("remote").alias("origin")))


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://(www\.|m\.)?', ''), '[?#].*$', '') AS base FROM pages)
SELECT page_id, base, count(*) OVER (PARTITION BY base) - 1 AS others, max(page_id) OVER (PARTITION BY base) AS newest FROM p""")
def versions_of_same_base(spark, d):
    base = F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.|m\.)?", ""), r"[?#].*$", "")
    w = Window.partitionBy("base")
    return load(spark, d, "pages").select("page_id", base.alias("base")).select("page_id", "base", (F.count(F.lit(1)).over(w) - 1).alias("others"), F.max("page_id").over(w).alias("newest"))


@query("""
SELECT doc_id, source, position, total, total > 30 AS partial, CASE WHEN total > 30 THEN 30 END AS next_offset FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS position, count(*) OVER (PARTITION BY source) AS total FROM documents)
WHERE position BETWEEN 11 AND 30""")
def index_page(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars")
    return W.page(docs, [F.desc("n_chars"), F.asc("doc_id")], 10, 20, ["source"]).drop("n_chars")


_NOTE = "text || ' #' || role || ' #turn-' || turn"


@query(f"""
SELECT tag, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all({_NOTE}, '#[\\p{{L}}\\p{{N}}_-]+')) AS tag FROM conversations)
GROUP BY tag""")
def notes_tags_facet(spark, d):
    note = F.concat(F.col("text"), F.lit(" #"), F.col("role"), F.lit(" #turn-"), F.col("turn").cast("string"))
    return load(spark, d, "conversations").select(F.explode(T.tags(note)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND contains(lower(text), 'the') AND (role = 'user' OR turn > 2)""")
def notes_filtered(spark, d):
    rows = load(spark, d, "conversations")
    chosen = ~F.col("role").isin("system") & F.contains(F.lower("text"), F.lit("the")) & ((F.col("role") == "user") | (F.col("turn") > 2))
    return rows.where(chosen).select("conv_id", "turn")


@query("""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 1 ELSE 0 END, CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) END ASC NULLS LAST, turn) AS place
FROM conversations""")
def notes_arranged_position(spark, d):
    key = F.when(F.col("turn") % 3 != 0, F.length("text"))
    w = Window.partitionBy("conv_id").orderBy((F.col("role") == "system").cast("int"), key.asc_nulls_last(), "turn")
    return load(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("place"))


@query("""
SELECT conv_id, turn, dense_rank() OVER (ORDER BY CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END) AS grp,
  row_number() OVER (PARTITION BY role ORDER BY turn DESC, conv_id) AS place FROM conversations""")
def notes_arranged_groups(spark, d):
    group = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role", group.alias("grp"))
    return W.ranked(rows, ["role"], [F.desc("turn"), F.col("conv_id")], "place").drop("role")


@query("""
SELECT CASE WHEN role = 'user' THEN 'question' WHEN length(text) > 400 THEN 'note' ELSE 'highlight' END AS kind, count(*) AS n, count(DISTINCT conv_id) AS papers
FROM conversations GROUP BY 1""")
def record_kind_counts(spark, d):
    kind = F.when(F.col("role") == "user", "question").when(F.length("text") > 400, "note").otherwise("highlight")
    return load(spark, d, "conversations").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("papers"))


@query("""
SELECT c.conv_id, count(*) AS n FROM conversations c WHERE EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = c.conv_id AND x.lang = 'en') GROUP BY c.conv_id""")
def notes_of_known_papers(spark, d):
    known = load(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("conv_id"))
    return load(spark, d, "conversations").join(known, "conv_id", "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, CASE WHEN props LIKE '%"k": 1%' THEN 'one' WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 50 THEN 'high' ELSE 'low' END AS class,
  CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type IN ('error', 'signup')""")
def classified_inputs(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.when(F.contains("props", F.lit('"k": 1')), "one").when(k >= 50, "high").otherwise("low")
    return load(spark, d, "events").where(F.col("event_type").isin("error", "signup")).select("event_id", name.alias("class"), k.alias("k"))
