"""Keyed state: queues, caches, gates and held-back streams as state machines over event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dml
from ..streaming import keyed
from ..tables import load

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def seconds(at: str = "ts"):
    return F.unix_micros(F.col(at).cast("timestamp")) / 1e6


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'done' WHEN 'error' THEN 'cancel' ELSE 'submit' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
q AS (
  SELECT user_id, event_id AS seq, n, CASE WHEN kind = 'submit' THEN event_id END AS running, []::BIGINT[] AS queue, CASE WHEN kind = 'submit' THEN event_id END AS started FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n,
    CASE WHEN kind = 'submit' THEN coalesce(running, event_id) WHEN kind = 'cancel' THEN running WHEN running IS NOT NULL THEN queue[nxt] END,
    CASE WHEN kind = 'submit' THEN CASE WHEN running IS NULL THEN queue ELSE list_append(queue, event_id) END
         WHEN kind = 'cancel' THEN CASE WHEN lst IS NULL THEN queue ELSE list_concat(list_append(queue[1:lst - 1], -1 - queue[lst]), queue[lst + 1:]) END
         WHEN running IS NULL THEN queue WHEN nxt IS NULL THEN []::BIGINT[] ELSE queue[nxt + 1:] END,
    CASE WHEN kind = 'submit' AND running IS NULL THEN event_id WHEN kind = 'done' AND running IS NOT NULL THEN queue[nxt] END
  FROM (SELECT e.user_id, e.event_id, e.n, e.kind, q.running, q.queue, list_position(list_transform(q.queue, lambda x: x >= 0), true) AS nxt,
               list_max(list_transform(range(1, len(q.queue) + 1), lambda i: CASE WHEN q.queue[i] >= 0 THEN i END)) AS lst
        FROM q JOIN e ON e.user_id = q.user_id AND e.n = q.n + 1))
SELECT user_id, seq, started, len(queue)::INT AS waiting FROM q""")
def fifo_starts(spark, d):
    """STM-04: which job of a key starts at which event; keys run side by side, cancelled jobs hold their place."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "done").when(F.col("event_type") == "error", "cancel").otherwise("submit")
    log = load(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"))
    return keyed.over_batch(log, "user_id", "seq", keyed.Queue())


#: Seconds that entries of the replayed cache live, and their number.
TTL, MOST = 200_000.0, 100


@query(f"""
WITH RECURSIVE e AS (SELECT user_id % 8 AS process, event_id, user_id || event_type AS entry, epoch(ts) AS sec, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n FROM events),
c AS (
  SELECT process, event_id AS call, n, false AS hit, CASE WHEN ok THEN [entry] ELSE [] END AS names, CASE WHEN ok THEN [sec + {TTL}] ELSE []::DOUBLE[] END AS ends, 0 AS evicted FROM e WHERE n = 1
  UNION ALL
  SELECT process, event_id, n, hit, CASE WHEN hit OR NOT ok THEN names ELSE list_append(kept, entry)[greatest(1, len(kept) + 2 - {MOST}):] END,
    CASE WHEN hit OR NOT ok THEN ends ELSE list_append(kept_ends, sec + {TTL})[greatest(1, len(kept) + 2 - {MOST}):] END, CASE WHEN hit OR NOT ok THEN 0 ELSE greatest(0, len(kept) + 1 - {MOST}) END
  FROM (SELECT *, coalesce(sec < ends[spot], false) AS hit, CASE WHEN spot IS NULL THEN names ELSE list_concat(names[1:spot - 1], names[spot + 1:]) END AS kept, CASE WHEN spot IS NULL THEN ends ELSE list_concat(ends[1:spot - 1], ends[spot + 1:]) END AS kept_ends
        FROM (SELECT e.process, e.event_id, e.n, e.entry, e.sec, e.ok, c.names, c.ends, list_position(c.names, e.entry) AS spot FROM c JOIN e ON e.process = c.process AND e.n = c.n + 1)))
SELECT process, call, hit, len(names)::INT AS entries, evicted::INT AS evicted FROM c""")
def cache_evictions(spark, d):
    """STM-11: a cache of 100 entries with a time to live, by process: hits, and what each call drives out."""
    rows = load(spark, d, "events").select((F.col("user_id") % 8).alias("process"), F.col("event_id").alias("call"), F.concat(F.col("user_id").cast("string"), "event_type").alias("entry"), seconds().alias("at"), (F.col("event_type") != "error").alias("ok"))
    return keyed.over_batch(rows, "process", "call", keyed.Cache(TTL, MOST))


#: Seconds between calls of a service, and that it rests after a failure.
GAP, REST = 300.0, 1800.0


@query(f"""
WITH RECURSIVE e AS (SELECT event_type AS service, event_id, epoch(ts) AS sec, value > 0.2 AS ok, row_number() OVER w AS n, lead(epoch(ts)) OVER w AS newer FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
g AS (
  SELECT service, event_id AS call, n, sec AS starts, sec > newer AS stale, false AS refused, ok, CASE WHEN sec > newer THEN 0.0 ELSE sec + {GAP} END AS nxt, CASE WHEN NOT ok AND NOT coalesce(sec > newer, false) THEN sec + {REST} ELSE 0.0 END AS resume FROM e WHERE n = 1
  UNION ALL
  SELECT service, event_id, n, starts, stale, refused, ok, CASE WHEN stale OR refused THEN nxt ELSE starts + {GAP} END, CASE WHEN stale OR refused OR ok THEN resume ELSE starts + {REST} END
  FROM (SELECT *, coalesce(starts > newer, false) AS stale, starts < resume AS refused FROM (SELECT e.service, e.event_id, e.n, e.ok, e.newer, greatest(e.sec, g.nxt) AS starts, g.nxt, g.resume FROM g JOIN e ON e.service = g.service AND e.n = g.n + 1)))
SELECT service, call, CASE WHEN stale THEN 'stale' WHEN refused THEN 'refused' WHEN ok THEN 'called' ELSE 'failed' END AS outcome, CASE WHEN NOT coalesce(stale, false) AND NOT refused THEN starts END AS starts FROM g""")
def gated_calls(spark, d):
    """STM-10: calls by service: when each starts, which a newer one replaces while they wait, which a resting service refuses."""
    rows = load(spark, d, "events").select(F.col("event_type").alias("service"), F.col("event_id").alias("call"), seconds().alias("at"), (F.col("value") > 0.2).alias("ok"))
    return keyed.over_batch(rows, "service", "call", keyed.Gate(GAP, REST))


@query("""
WITH c AS (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN 'sec' ELSE 'ret-key' END AS part, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
t AS (SELECT conv_id, string_agg(part, '' ORDER BY turn) AS t, conv_id % 5 = 0 AS stopped FROM c GROUP BY conv_id)
SELECT conv_id, sha256(CASE WHEN stopped THEN substr(replace(t, 'secret-key', '[REDACTED]'), 1, greatest(0, length(replace(t, 'secret-key', '[REDACTED]')) - 9)) ELSE replace(t, 'secret-key', '[REDACTED]') END) AS left_sha256 FROM t""")
def held_streams(spark, d):
    """STM-08: what leaves each stream of parts, whole texts, a secret masked across parts; every fifth stream is stopped."""
    rows = load(spark, d, "conversations")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    tail = F.when(F.col("turn") % 2 == 0, "sec").otherwise("ret-key")
    ends = F.when(F.col("turn") == F.col("last"), F.when(F.col("conv_id") % 5 == 0, "stopped").otherwise("done"))
    parts = rows.join(last, "conv_id").select("conv_id", F.col("turn").alias("seq"), F.concat("text", tail).alias("part"), ends.alias("ends"))
    left = keyed.over_batch(parts, "conv_id", "seq", keyed.HoldBack("secret-key"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "")
    return left.groupBy("conv_id").agg(F.sha2(text.cast("binary"), 256).alias("left_sha256"))


@query("""
WITH RECURSIVE r AS (SELECT c_custkey AS user_id, md5(c_name) AS digest FROM customer WHERE c_custkey % 3 <> 0),
e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'edit' WHEN 'error' THEN 'delete' ELSE 'search' END AS kind, CASE WHEN value > 0.1 THEN md5(event_id::VARCHAR) END AS made, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
w AS (SELECT e.user_id, event_id, n, kind, r.digest AS was, CASE WHEN prev IS NULL THEN r.digest WHEN event_id % 3 = 0 THEN 'stale' ELSE md5(prev::VARCHAR) END AS expected, CASE WHEN kind = 'edit' THEN md5(event_id::VARCHAR) ELSE made END AS made FROM e LEFT JOIN r ON r.user_id = e.user_id),
p AS (SELECT user_id, n - 1 AS n, was AS digest, NULL::BIGINT AS event_id, false AS applied FROM w WHERE n = 1
  UNION ALL SELECT user_id, n, CASE WHEN NOT ok THEN cur WHEN kind = 'delete' THEN NULL ELSE made END, event_id, ok
  FROM (SELECT w.*, p.digest AS cur, coalesce(w.kind = 'edit' OR (p.digest IS NOT NULL AND (w.kind = 'delete' OR (p.digest = w.expected AND w.made IS NOT NULL))), false) AS ok FROM p JOIN w ON w.user_id = p.user_id AND w.n = p.n + 1)),
t AS (SELECT user_id, arg_max(digest, n) AS digest, max(event_id) FILTER (applied) AS event_id, max(n) AS n FROM (SELECT user_id, n, event_id, applied, coalesce(digest, '-') AS digest FROM p) GROUP BY user_id)
SELECT 'log' AS part, user_id, event_id, applied, digest FROM p WHERE event_id IS NOT NULL
UNION ALL SELECT 'table', user_id, event_id, true, digest FROM t WHERE digest <> '-'
UNION ALL SELECT 'table', user_id, NULL, true, digest FROM r WHERE user_id NOT IN (SELECT user_id FROM e WHERE user_id IS NOT NULL)""")
def conditional_merges(spark, d):
    """ANC-08: records searched again are written only if their digest is still the one that was searched; edits and deletes win."""
    events = load(spark, d, "events")
    old = load(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"), F.md5(F.col("c_name").cast("binary")).alias("digest"), F.lit(None).cast("long").alias("event_id"))
    md5 = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    kind = F.when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "error", "delete").otherwise("search")
    log = events.select("user_id", "event_id", kind.alias("kind"), "value", before.alias("prev")).join(old.select("user_id", F.col("digest").alias("first")), "user_id", "left")
    expected = F.when(F.col("prev").isNull(), F.col("first")).when(F.col("event_id") % 3 == 0, "stale").otherwise(md5("prev"))
    made = F.when((F.col("kind") == "edit") | (F.col("value") > 0.1), md5("event_id"))
    writes = log.select("user_id", F.col("event_id").alias("seq"), "event_id", "kind", expected.alias("expected"), made.alias("made"))
    table, done = dml.conditional_merge(old, writes, "user_id", "digest", "seq")
    rows = done.select(F.lit("log").alias("part"), "user_id", "event_id", "applied", "digest")
    return rows.unionByName(table.select(F.lit("table").alias("part"), "user_id", "event_id", F.lit(True).alias("applied"), "digest"))


@query("""
WITH o AS (SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 4 <> 1), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS digest FROM documents WHERE doc_id % 3 <> 0),
c AS (SELECT o.doc_id FROM o JOIN n USING (doc_id) WHERE o.digest IS DISTINCT FROM n.digest)
SELECT 'paper' AS part, doc_id, digest AS value FROM n UNION ALL SELECT 'paper', doc_id, digest FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)
UNION ALL SELECT 'generation', doc_id, quality::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM c)""")
def saved_papers(spark, d):
    """DML-02: papers are saved, and the generations of those whose content changed are deleted: both tables afterwards."""
    docs, md5 = load(spark, d, "documents"), lambda x: F.md5(x.cast("binary"))
    old = docs.where("doc_id % 4 <> 1").select("doc_id", md5(F.col("text")).alias("digest"))
    new = docs.where("doc_id % 3 <> 0").select("doc_id", md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("digest"))
    papers, generations = dml.saved(old, new, load(spark, d, "labels").select(F.col("doc_id").alias("paper"), "quality"), "doc_id", "digest", "paper")
    rows = papers.select(F.lit("paper").alias("part"), "doc_id", F.col("digest").alias("value"))
    return rows.unionByName(generations.select(F.lit("generation").alias("part"), F.col("paper").alias("doc_id"), F.col("quality").cast("string").alias("value")))
