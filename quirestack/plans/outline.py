"""Queries over sections, figures, runs and their states, versions and exports.

Documents stand for papers, their lines for passages, conversations for records, events for logs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import diff, graph
from ..streaming import jobs
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


_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
q AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos FROM l WHERE trim(line) <> '')"""


def _lines(spark, d):
    return passages(load(spark, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


# ---- joins -----------------------------------------------------------------------------------


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://(www\.|m\.)?', ''), '[?#].*$', '') AS base, length(html) AS n FROM pages)
SELECT a.page_id, arg_max(b.page_id, b.n * 1000000 - b.page_id) AS best FROM p a JOIN p b ON a.base = b.base AND b.page_id < a.page_id GROUP BY a.page_id""")
def best_older_version(spark, d):
    """JN-09: of the older versions of a page the one with most content, by a running maximum over its versions."""
    base = F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.|m\.)?", ""), r"[?#].*$", "")
    w = Window.partitionBy("base").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = load(spark, d, "pages").select("page_id", base.alias("base"), F.length("html").alias("n"))
    return rows.select("page_id", F.max(F.struct("n", (-F.col("page_id")).alias("k"))).over(w).alias("b")).where("b IS NOT NULL").select("page_id", (-F.col("b.k")).alias("best"))


@query("""
WITH f AS (SELECT conv_id AS id, turn, text AS fragment FROM conversations WHERE role = 'user'), r AS (SELECT conv_id AS id, turn - 1 AS turn, text || CASE WHEN turn % 4 = 1 THEN ' ' || text ELSE '' END AS entry FROM conversations WHERE role = 'assistant')
SELECT f.id, f.turn FROM f JOIN r ON f.id = r.id AND f.turn = r.turn WHERE NOT contains(r.entry, left(f.fragment, 3))""")
def fragments_not_contained(spark, d):
    """JN-11: bibliography fragments whose entry of the same id doesn't hold them."""
    rows = load(spark, d, "conversations")
    fragments = rows.where("role = 'user'").select(F.col("conv_id").alias("id"), "turn", F.left("text", F.lit(3)).alias("fragment"))
    entry = F.concat("text", F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" "), F.col("text"))).otherwise(""))
    entries = rows.where("role = 'assistant'").select(F.col("conv_id").alias("id"), (F.col("turn") - 1).alias("turn"), entry.alias("entry"))
    return fragments.join(entries, ["id", "turn"]).where(~F.contains("entry", F.col("fragment"))).select("id", "turn")


@query("""
WITH c AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 4 <> 1), b AS (SELECT doc_id, quality AS q0 FROM labels WHERE doc_id % 4 <> 2), allowed AS (SELECT doc_id, 0 AS new FROM labels WHERE toxic = 1)
SELECT c.doc_id, coalesce(b.q0, -1) AS old, c.quality AS new, a.doc_id IS NOT NULL AS allowed FROM c LEFT JOIN b ON c.doc_id = b.doc_id LEFT JOIN allowed a ON a.doc_id = c.doc_id AND a.new = c.quality""")
def changes_allowed(spark, d):
    """JN-13, JN-14: a run against its base, an empty one where it has none, and whether an allow-list names the change."""
    labels = load(spark, d, "labels")
    base = labels.where("doc_id % 4 <> 2").select("doc_id", F.col("quality").alias("q0"))
    allowed = labels.where("toxic = 1").select("doc_id", F.lit(0).alias("quality"), F.lit(True).alias("allowed")).distinct()
    rows = labels.where("doc_id % 4 <> 1").join(base, "doc_id", "left").join(allowed, ["doc_id", "quality"], "left")
    return rows.select("doc_id", F.coalesce("q0", F.lit(-1)).alias("old"), F.col("quality").alias("new"), F.coalesce("allowed", F.lit(False)).alias("allowed"))


@query("""
SELECT p_partkey, name FROM (SELECT p.p_partkey, c.name, row_number() OVER (PARTITION BY p.p_partkey ORDER BY length(c.name) DESC, c.name) AS r
FROM part p JOIN (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size < 10) c ON contains(' ' || lower(p.p_name || ' ' || p.p_type), ' ' || lower(c.name))) WHERE r = 1""")
def component_hooks(spark, d):
    """JN-16: the longest component whose name a node's text holds; names begin at words and are met through their first."""
    part = load(spark, d, "part")
    names = part.select(F.col("p_type").alias("name")).union(part.select(F.split_part("p_name", F.lit(" "), F.lit(2)))).union(part.where("p_size < 10").select("p_name")).distinct()
    names = names.withColumn("word", F.split_part(F.lower("name"), F.lit(" "), F.lit(1)))
    nodes = part.select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"))
    words = nodes.select("p_partkey", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    hits = words.join(names, "word").where(F.contains(F.concat(F.lit(" "), F.col("text")), F.concat(F.lit(" "), F.lower("name"))))
    return hits.groupBy("p_partkey").agg(F.min(F.struct((-F.length("name")).alias("n"), "name")).alias("b")).select("p_partkey", "b.name")


@query("""
WITH a AS (SELECT conv_id, turn, text, unnest([turn - 1, turn - 2]) AS ref FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, a.turn, string_agg('[' || a.ref || '] ' || coalesce(p.text, 'missing'), chr(10) ORDER BY a.ref) AS sheet, count(p.turn) AS cited FROM a LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.ref GROUP BY a.conv_id, a.turn""")
def grading_sheet(spark, d):
    """JN-17, SNK-05: answers beside the passages they cite."""
    rows = load(spark, d, "conversations")
    asked = rows.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.array(F.col("turn") - 1, F.col("turn") - 2)).alias("ref"))
    cited = asked.join(rows.select("conv_id", F.col("turn").alias("ref"), "text"), ["conv_id", "ref"], "left")
    line = F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("] "), F.coalesce("text", F.lit("missing")))
    sheet = cited.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("ref", line.alias("l")))).alias("r"), F.count("text").alias("cited"))
    return sheet.select("conv_id", "turn", F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("sheet"), "cited")


@query("""
WITH e AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS used, list_sort(list(DISTINCT CASE WHEN value > 20 THEN event_type END) FILTER (value > 20)) AS defined, bool_or(value > 180) AS generated FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN generated THEN [] ELSE list_filter(used, lambda x: NOT list_contains(coalesce(defined, []), x)) END AS missing FROM e""")
def undefined_references(spark, d):
    """JN-20: references without a definition, none where some definition is generated."""
    sums = load(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("u"), F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("d"), F.bool_or(F.col("value") > 180).alias("g"))
    return sums.select("user_id", F.when(F.col("g"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except("u", "d"))).alias("missing"))


# ---- aggregations ----------------------------------------------------------------------------


@query("""
SELECT user_id, count(*) FILTER (event_type = 'view') AS found, count(*) FILTER (event_type = 'click') AS moved, count(*) FILTER (event_type = 'error') AS lost, sum(CAST(json_extract_string(props, '$.k') AS INT))::BIGINT AS tokens,
  count(*) FILTER (event_type = 'view' AND (props = '{"k": 1}' OR starts_with(props, '{"k": 1'))) AS requests, greatest(0, count(*) FILTER (event_type = 'click') - 1) AS corrections,
  CASE WHEN bool_or(event_type = 'purchase') THEN 'accepted' WHEN count(*) FILTER (event_type = 'click') >= 4 THEN 'omitted' ELSE 'pending' END AS state FROM events GROUP BY user_id""")
def run_accounting(spark, d):
    """AGG-05, AGG-12, AGG-27, AGG-28: what was found, tokens, requests of a label, corrections, the state they lead to."""
    is_ = lambda t: F.col("event_type") == t
    clicks = F.count_if(is_("click"))
    return load(spark, d, "events").groupBy("user_id").agg(
        F.count_if(is_("view")).alias("found"), clicks.alias("moved"), F.count_if(is_("error")).alias("lost"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("tokens"),
        F.count_if(is_("view") & F.startswith("props", F.lit('{"k": 1'))).alias("requests"), F.greatest(F.lit(0), clicks - 1).alias("corrections"),
        F.when(F.bool_or(is_("purchase")), "accepted").when(clicks >= 4, "omitted").otherwise("pending").alias("state"),
    )


@query(r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages), h AS (SELECT page_id, count(DISTINCT h) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) GROUP BY page_id)
SELECT t.page_id, count(*) FILTER (tag IN ('p', 'li')) AS blocks, count(*) FILTER (regexp_matches(tag, '^h[1-6]$')) AS headings, count(*) FILTER (tag IN ('nav', 'footer', 'header', 'article')) AS areas, coalesce(any_value(h.targets), 0) AS targets FROM t LEFT JOIN h ON h.page_id = t.page_id GROUP BY t.page_id""")
def environment_counts(spark, d):
    """AGG-18, AGG-19: environments by class, and distinct targets; each page is counted in its own row."""
    tags = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    rows = load(spark, d, "pages").select("page_id", tags.alias("t"), F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h")).where(F.size("t") > 0)
    count = lambda test: F.size(F.filter("t", test)).cast("long")
    return rows.select(
        "page_id", count(lambda x: x.isin("p", "li")).alias("blocks"), count(lambda x: x.rlike("^h[1-6]$")).alias("headings"), count(lambda x: x.isin("nav", "footer", "header", "article")).alias("areas"), F.size("h").cast("long").alias("targets")
    )


@query("""
WITH e AS (SELECT props, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY props), t AS (SELECT sum(n)::BIGINT AS total FROM e)
SELECT props, n, total, total > 20 AS fails FROM e, t ORDER BY n DESC, props LIMIT 5""")
def common_errors(spark, d):
    """AGG-20: the five most common errors, the total, and whether it is too many."""
    counts = load(spark, d, "events").where("event_type = 'error'").groupBy("props").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), "props").limit(5).crossJoin(F.broadcast(total)).withColumn("fails", F.col("total") > 20)


@query(f"""
WITH {_LINES}, s AS (SELECT doc_id, pos, line, max(CASE WHEN length(line) < 60 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM q)
SELECT doc_id, coalesce(section, -1) AS section, sum(length(line))::BIGINT AS chars, list(pos ORDER BY pos) AS passages, bool_or(contains(lower(line), 'license')) AS has_notice FROM s GROUP BY ALL""")
def section_sums(spark, d):
    """AGG-22, DOC-06, WIN-18: sections with their size, passages and marks."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(spark, d).withColumn("section", F.coalesce(F.max(F.when(F.length("line") < 60, F.col("pos"))).over(w), F.lit(-1)))
    return rows.groupBy("doc_id", "section").agg(F.sum(F.length("line")).alias("chars"), F.array_sort(F.collect_list("pos")).alias("passages"), F.bool_or(F.contains(F.lower("line"), F.lit("license"))).alias("has_notice"))


# ---- windows ---------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'reset' WHEN turn % 5 = 4 THEN 'none' WHEN turn % 5 = 3 THEN 'tag' ELSE 'number' END AS kind FROM conversations),
g AS (SELECT *, count(*) FILTER (kind = 'reset') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS part FROM r)
SELECT conv_id, turn, CASE WHEN kind = 'number' THEN CAST(count(*) FILTER (kind = 'number') OVER (PARTITION BY conv_id, part ORDER BY turn ROWS UNBOUNDED PRECEDING) AS VARCHAR) WHEN kind = 'tag' THEN 'T' || turn END AS number FROM g""")
def equation_numbers(spark, d):
    """WIN-06: a running number that some rows reset, some replace by a tag, and some don't take."""
    kind = F.when(F.col("role") == "system", "reset").when(F.col("turn") % 5 == 4, "none").when(F.col("turn") % 5 == 3, "tag").otherwise("number")
    rows = load(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"))
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.count_if(F.col("kind") == "reset").over(upto))
    count = F.count_if(F.col("kind") == "number").over(Window.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    number = F.when(F.col("kind") == "number", count.cast("string")).when(F.col("kind") == "tag", F.concat(F.lit("T"), F.col("turn").cast("string")))
    return rows.select("conv_id", "turn", number.alias("number"))


@query()
def passages_around(spark, d):
    """WIN-14: around each document's middle passage as many neighbours, below and above in turn, as 2,000 characters hold."""
    lengths = passages(load(spark, d, "documents")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.length("line").alias("n")))), lambda x: x["n"]).alias("n"))
    middle = F.call_function("div", F.size("n"), F.lit(2)).cast("int")
    return lengths.select("doc_id", middle.alias("middle"), expanded(F.col("n"), middle, 2000).alias("r")).select("doc_id", "middle", "r.low", "r.high")


def expanded(sizes, start, room: int):
    """struct<low, high> around start: the neighbour below and the one above are taken in turn while they fit, until neither does."""
    def grown(a, side: int):
        at = F.when(F.lit(side < 0), a["low"] - 1).otherwise(a["high"] + 1)
        cost = F.when((at >= 0) & (at < F.size(sizes)), F.get(sizes, at))
        fits = F.coalesce(a["room"] >= cost, F.lit(False))
        return F.struct(
            F.when(fits & F.lit(side < 0), at).otherwise(a["low"]).alias("low"), F.when(fits & F.lit(side > 0), at).otherwise(a["high"]).alias("high"), F.when(fits, a["room"] - cost).otherwise(a["room"]).alias("room")
        )

    begin = F.struct(start.alias("low"), start.alias("high"), (F.lit(room) - F.get(sizes, start)).alias("room"))
    bound = lambda a, make: F.element_at(F.transform(F.array(a), make), 1)
    return F.aggregate(sizes, begin, lambda a, _: bound(grown(a, -1), lambda b: grown(b, 1)), lambda a: F.struct(a["low"].alias("low"), a["high"].alias("high")))


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber, (l_quantity::INT % 4) + 2 AS level FROM lineitem)
SELECT l_orderkey, l_linenumber, level - min(level) OVER (PARTITION BY l_orderkey) + 1 AS level FROM h""")
def outline_levels(spark, d):
    """WIN-16: levels rebased to an outline's least."""
    level = F.col("l_quantity").cast("int") % 4 + 2
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", level.alias("level"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("level") - F.min("level").over(Window.partitionBy("l_orderkey")) + 1).alias("level"))


@query("""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'system' THEN 0 ELSE 1 END, length(text) % 7, turn) AS place,
  arg_max(turn, CASE WHEN role = 'user' THEN length(text) * 100 - turn END) OVER (PARTITION BY conv_id) AS scoped FROM conversations""")
def notes_page_order(spark, d):
    """SRT-04, TOP-07: notes by flag, passage and time; the best of a scope beside them."""
    w = Window.partitionBy("conv_id")
    order = [(F.col("role") != "system").cast("int"), F.length("text") % 7, F.col("turn")]
    best = F.max(F.when(F.col("role") == "user", F.struct((F.length("text") * 100 - F.col("turn")).alias("k"), "turn"))).over(w)
    return load(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy(*order)).alias("place"), best["turn"].alias("scoped"))


# ---- documents and versions ------------------------------------------------------------------


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:p|li|h1)>([^<]*)', 1)) AS item, generate_subscripts(regexp_extract_all(html, '<(?:p|li|h1)>([^<]*)', 1), 1) AS pos FROM pages)
SELECT page_id, pos - 1 AS pos, md5(trim(item)) AS digest, row_number() OVER (PARTITION BY page_id, trim(item) ORDER BY pos DESC) - 1 AS earlier FROM l""")
def content_snapshot(spark, d):
    """DOC-11, DOC-04: a page's items in order; of items with one name the last keeps it, earlier ones are numbered."""
    items = F.regexp_extract_all("html", F.lit("<(?:p|li|h1)>([^<]*)"), F.lit(1))
    rows = load(spark, d, "pages").select("page_id", F.posexplode(items).alias("pos", "item")).withColumn("item", F.trim("item"))
    again = F.row_number().over(Window.partitionBy("page_id", "item").orderBy(F.desc("pos"))) - 1
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("item").cast("binary")).alias("digest"), again.alias("earlier"))


@query("""
WITH e AS (SELECT user_id, event_type, list_distinct(list(event_type || ':' || props ORDER BY event_id)) AS ids FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || len(ids), ';' ORDER BY event_type) AS coverage, sum(len(ids))::BIGINT AS total FROM e GROUP BY user_id""")
def merged_evidence(spark, d):
    """DOC-09, SET-05: evidence of several lookups merged without repeats, and rendered."""
    sets = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_distinct("props").alias("n"))
    line = F.concat("event_type", F.lit("="), F.col("n").cast("string"))
    return sets.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(line)), ";").alias("coverage"), F.sum("n").alias("total"))


@query()
def changed_words(spark, d):
    """DIF-02: conversations whose text an edit changed, as the changed words with their neighbours."""
    rows = load(spark, d, "conversations")
    edited = F.regexp_replace("text", r"(?<=\s)([a-z])([a-z]{6,})(?=\s)", "$2$1")
    return rows.where(F.col("text") != edited).select("conv_id", "turn", diff.word_changes(F.col("text"), edited).alias("changes"))


@query(f"""
WITH {_LINES}, t AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{{9,}}')[1] AS token FROM benchmark),
h AS (SELECT t.item_id, q.doc_id, q.pos, CASE WHEN contains(lower(q.line), 'license') THEN 0 WHEN contains(q.line, t.token || ',') THEN 1 ELSE 2 END AS rank FROM t JOIN q ON contains(' ' || trim(regexp_replace(lower(q.line), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || lower(t.token) || ' ') WHERE t.token IS NOT NULL)
SELECT item_id, doc_id, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank, doc_id, pos) AS r FROM h) WHERE r <= 3""")
def token_locations(spark, d):
    """DIF-07: the three best lines that hold a token: definitions before exact uses before others."""
    token = F.get(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0)), 0)
    wanted = load(spark, d, "benchmark").select("item_id", token.alias("token")).where("token IS NOT NULL").withColumn("word", F.lower("token"))
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " ")), " "))
    lines = _lines(spark, d)
    spots = lines.select("doc_id", "pos", F.explode(words).alias("word")).join(wanted, "word").join(lines, ["doc_id", "pos"])
    rank = F.when(F.contains(F.lower("line"), F.lit("license")), 0).when(F.contains("line", F.concat("token", F.lit(","))), 1).otherwise(2)
    best = Window.partitionBy("item_id").orderBy("rank", "doc_id", "pos")
    return spots.withColumn("rank", rank).withColumn("r", F.row_number().over(best)).where("r <= 3").select("item_id", "doc_id", "pos", "rank")


@query("""
WITH RECURSIVE edges AS (SELECT 'r' || r_regionkey AS a, 'n' || n_nationkey AS b FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_nationkey % 5 = 0),
w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS spot, ['r' || r_regionkey] AS path, 0 AS depth FROM region UNION ALL SELECT w.root, e.b, list_append(w.path, e.b), w.depth + 1 FROM w JOIN edges e ON e.a = w.spot WHERE NOT list_contains(w.path, e.b))
SELECT root, max(depth) AS depth FROM w GROUP BY root""")
def include_depths(spark, d):
    """DIF-12: the longest chain of includes that meets no file twice, by project."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, region = load(spark, d, "nation"), load(spark, d, "region")
    key = F.col("n_regionkey").alias("k")
    down = nation.select(key, name("r", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b"))
    leaves = load(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(key, name("n", "s_nationkey").alias("a"), name("s", "s_suppkey").alias("b"))
    up = nation.where("n_nationkey % 5 = 0").select(key, name("n", "n_nationkey").alias("a"), name("r", "n_regionkey").alias("b"))
    return graph.include_depth(down.union(leaves).union(up), region.select(F.col("r_regionkey").alias("k"), name("r", "r_regionkey").alias("a")), ["k"]).drop("k")


# ---- states ----------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events), s AS (SELECT *, CASE WHEN event_type = 'error' THEN 'cancelled' END AS state FROM e)
SELECT user_id, event_id, turn, count(*) FILTER (state IS NULL) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS runs_after, state FROM s""")
def fifo_places(spark, d):
    """STM-04: each key's jobs in order of arrival; a cancelled one holds its place and runs nothing."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    state = F.when(F.col("event_type") == "error", "cancelled")
    rows = load(spark, d, "events").select("user_id", "event_id", state.alias("state"))
    return rows.select("user_id", "event_id", F.row_number().over(w).alias("turn"), F.count_if(F.col("state").isNull()).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("runs_after"), "state")


@query("""
WITH t AS (SELECT conv_id, min(turn) FILTER (role = 'system') AS stop FROM conversations WHERE turn > 0 GROUP BY conv_id)
SELECT c.conv_id, count(*) AS parts, md5(string_agg(c.text, '' ORDER BY c.turn)) AS answer, max(c.turn) AS last FROM conversations c LEFT JOIN t ON t.conv_id = c.conv_id WHERE t.stop IS NULL OR c.turn < t.stop GROUP BY c.conv_id""")
def streamed_answers(spark, d):
    """STM-07: the text of an answer from its parts, up to the event that ends it."""
    rows = load(spark, d, "conversations")
    stop = rows.where("turn > 0 AND role = 'system'").groupBy("conv_id").agg(F.min("turn").alias("stop"))
    kept = rows.join(stop, "conv_id", "left").where("stop IS NULL OR turn < stop")
    parts = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    return parts.select("conv_id", F.size("r").cast("long").alias("parts"), F.md5(F.array_join(F.transform("r", lambda x: x["text"]), "").cast("binary")).alias("answer"), F.element_at("r", -1)["turn"].alias("last"))


@query("""
WITH c AS (SELECT conv_id, string_agg(text || CASE WHEN turn % 2 = 0 THEN 'sec' ELSE 'ret-key' END, '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, replace(t, 'secret-key', '[REDACTED]') AS text FROM c WHERE NOT contains(replace(t, 'secret-key', '[REDACTED]'), 'secret-key')""")
def redacted_streams(spark, d):
    """STM-08: a secret that is cut across parts of a stream never leaves; what has left is joined again."""
    tail = F.when(F.col("turn") % 2 == 0, "sec").otherwise("ret-key")
    parts = load(spark, d, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("part"))
    left = jobs.held_back(parts, "conv_id", "turn", "part", "secret-key")
    return left.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("r")).select("conv_id", F.array_join(F.transform("r", lambda x: x["part"]), "").alias("text"))


@query("""
WITH e AS (SELECT user_id, event_id, epoch(ts) AS sec, event_type, lag(epoch(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS last, max(event_id) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS newest FROM events)
SELECT user_id, event_id, last IS NULL OR sec - last >= 3600 AS passes, event_id < newest AS stale FROM e""")
def rate_gates(spark, d):
    """STM-10: calls that keep the gap after the one before, and those that a newer one replaced."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = load(spark, d, "events").select("user_id", "event_id", at.alias("at"), "ts", F.lag(at).over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("last"), F.max("event_id").over(Window.partitionBy("user_id", F.date_trunc("day", "ts"))).alias("newest"))
    return rows.select("user_id", "event_id", (F.col("last").isNull() | (F.col("at") - F.col("last") >= 3600)).alias("passes"), (F.col("event_id") < F.col("newest")).alias("stale"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error'),
c AS (SELECT user_id, event_type, event_id, n, sec AS filled, false AS hit FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.n, CASE WHEN e.sec < c.filled + 86400 THEN c.filled ELSE e.sec END, e.sec < c.filled + 86400 FROM c JOIN e ON e.user_id = c.user_id AND e.event_type = c.event_type AND e.n = c.n + 1)
SELECT user_id, event_type, event_id, hit FROM c""")
def cache_replay(spark, d):
    """STM-11: a cache with a time to live: an entry is filled again when it is too old; failures are never kept."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = load(spark, d, "events").where("event_type <> 'error'").select("user_id", "event_type", "event_id", at.alias("at"))
    return jobs.cache_hits(rows, ["user_id", "event_type"], "event_id", "at", 86400).select("user_id", "event_type", "event_id", "hit")


@query("""
SELECT user_id, props, count(*) AS attempts, arg_max(event_type, event_id) AS status, string_agg(event_type, '>' ORDER BY event_id) AS trace, min(event_id) FILTER (event_type = 'purchase') AS ended FROM events GROUP BY user_id, props""")
def retry_traces(spark, d):
    """STM-12, STM-13: attempts, the trace of states, the last of them, and the one terminal record."""
    rows = load(spark, d, "events").groupBy("user_id", "props").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("r"), F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("ended")
    )
    return rows.select("user_id", "props", F.size("r").cast("long").alias("attempts"), F.element_at("r", -1)["event_type"].alias("status"), F.array_join(F.transform("r", lambda x: x["event_type"]), ">").alias("trace"), "ended")


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN CAST(json_extract_string(props, '$.k') AS INT) END AS used, event_type = 'error' AS done FROM events WHERE event_type <> 'signup'""")
def server_events(spark, d):
    """STM-09: lines of an event stream: data lines parsed, the end mark told, all others left out."""
    line = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("data: "), F.col("props"))).when(F.col("event_type") == "error", "data: [DONE]").when(F.col("event_type") == "purchase", "data: {}").otherwise(": ping")
    rows = load(spark, d, "events").select("event_id", jobs.event_line(line).alias("e")).where("e IS NOT NULL")
    return rows.select("event_id", F.get_json_object("e.data", "$.k").cast("int").alias("used"), "e.done")


# ---- writes ----------------------------------------------------------------------------------


@query("""
WITH o AS (SELECT doc_id AS k, md5(text) AS digest, doc_id % 3 = 0 AS ready, CASE WHEN doc_id % 2 = 0 THEN 'epub' ELSE 'pdf' END AS format FROM documents), n AS (SELECT doc_id AS k, CASE WHEN doc_id % 5 = 0 THEN md5(text || '!') ELSE md5(text) END AS digest, doc_id % 7 = 0 AS failed, CASE WHEN doc_id % 4 < 2 THEN 'pdf' ELSE 'epub' END AS format FROM documents)
SELECT o.k, CASE WHEN failed AND ready THEN 'kept' WHEN NOT failed AND n.format = 'pdf' AND o.format = 'epub' AND ready THEN 'refused' WHEN o.digest = n.digest THEN 'same' ELSE 'replaced' END AS outcome,
  NOT (failed AND ready) AND NOT (NOT failed AND n.format = 'pdf' AND o.format = 'epub' AND ready) AND o.digest <> n.digest AS drops_explanations FROM o JOIN n ON o.k = n.k""")
def retained_papers(spark, d):
    """DML-02, DML-08: a failed retry keeps a ready paper, a lesser format never replaces a better one, equal content keeps its explanations."""
    docs, k, md5 = load(spark, d, "documents"), F.col("doc_id"), lambda x: F.md5(x.cast("binary"))
    old = docs.select(k.alias("k"), md5(F.col("text")).alias("was"), (k % 3 == 0).alias("ready"), F.when(k % 2 == 0, "epub").otherwise("pdf").alias("form"))
    new = docs.select(k.alias("k"), md5(F.when(k % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("now"), (k % 7 == 0).alias("failed"), F.when(k % 4 < 2, "pdf").otherwise("epub").alias("format"))
    both = old.join(new, "k")
    kept, refused = F.col("failed") & F.col("ready"), ~F.col("failed") & F.col("ready") & (F.col("format") == "pdf") & (F.col("form") == "epub")
    outcome = F.when(kept, "kept").when(refused, "refused").when(F.col("was") == F.col("now"), "same").otherwise("replaced")
    return both.select("k", outcome.alias("outcome"), (~kept & ~refused & (F.col("was") != F.col("now"))).alias("drops_explanations"))


@query("""
SELECT md5(c.conv_id || '/' || t.target || '/' || c.turn) AS id, t.target AS paper, c.turn, c.text FROM conversations c JOIN (SELECT conv_id, conv_id + 1000000 AS target FROM conversations WHERE turn = 0 AND role <> 'system') t ON t.conv_id = c.conv_id""")
def copied_records(spark, d):
    """DML-05: a key's records under another key, with fresh ids that a retry makes again."""
    rows = load(spark, d, "conversations")
    moves = rows.where("turn = 0 AND role <> 'system'").select("conv_id", (F.col("conv_id") + 1000000).alias("paper"))
    return rows.join(moves, "conv_id").select(F.md5(F.concat_ws("/", "conv_id", "paper", "turn").cast("binary")).alias("id"), "paper", "turn", "text")


@query("""
WITH b AS (SELECT user_id, bool_and(value > 0.05) AS good FROM events GROUP BY user_id)
SELECT e.user_id, e.event_type AS record, arg_max(props, event_id) AS value FROM events e JOIN b ON b.user_id = e.user_id WHERE b.good GROUP BY ALL""")
def batch_edits(spark, d):
    """DML-11: the last edit of each record wins; a batch with a bad edit changes nothing."""
    rows = load(spark, d, "events")
    good = rows.groupBy("user_id").agg(F.bool_and(F.col("value") > 0.05).alias("good")).where("good")
    return rows.join(good, "user_id", "left_semi").groupBy("user_id", F.col("event_type").alias("record")).agg(F.max_by("props", "event_id").alias("value"))


@query("""
SELECT conv_id AS paper, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS records, conv_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') AS orphan FROM conversations GROUP BY conv_id""")
def notes_backup(spark, d):
    """SNK-01: all records of every paper as JSON, those of papers that are gone, too."""
    known = load(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("paper"), F.lit(True).alias("known")).distinct()
    rows = load(spark, d, "conversations").groupBy(F.col("conv_id").alias("paper")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("records"))
    return rows.join(known, "paper", "left").select("paper", "records", F.col("known").isNull().alias("orphan"))
