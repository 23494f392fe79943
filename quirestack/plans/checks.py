"""Validation queries: rule tables over records, every failure with its path.

The tables hold no highlights, requests or settings, so records are made of their columns, some of them
spoiled by rules that a few rows meet; the same columns are made in both engines.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules
from ..tables import load

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def checked(name: str, table: str, key: list[str], columns: dict[str, str], rows: list[tuple[str, str, str]], doc: str):
    """Registers the issues of a rule table over columns made of a table, and its SQL."""

    def run(spark, d):
        records = load(spark, d, table).selectExpr(*key, *[f"{x} AS {c}" for c, x in columns.items()])
        return rules.issues(records, key, rules.table(rows)).select(*key, "rule", "path")

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    SQL[name] = rules.table_sql(f"SELECT {', '.join(key)}, {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM {table}", key, rows)


# Limits and choices of the records.
HIGHLIGHT = [
    ("id", "id", "regexp_like(id, '^[0-9a-f]{32}$')"),
    ("paper", "paper", "paper = source"),
    ("colour", "colour", "colour IN ('key', 'question', 'use', 'disagree')"),
    ("found", "found", "found IN ('found', 'moved', 'not-found')"),
    ("note", "note", "length(note) <= 10000"),
    ("quote", "quote", "length(quote) <= 20000"),
    ("prefix", "prefix", "length(prefix) <= 32"),
    ("suffix", "suffix", "length(suffix) <= 32"),
    ("order", "order", "place IS NOT NULL AND NOT isnan(place) AND abs(place) < CAST('infinity' AS DOUBLE)"),
    ("end", "end", "tail IS NULL OR length(tail) <= 32"),
]
checked(
    "validated_highlights", "documents", ["doc_id"],
    {
        "source": "source", "id": "CASE WHEN doc_id % 11 = 0 THEN upper(md5(text)) ELSE md5(text) END", "paper": "CASE WHEN doc_id % 17 = 3 THEN lang ELSE source END",
        "colour": "CASE doc_id % 6 WHEN 0 THEN 'key' WHEN 1 THEN 'question' WHEN 2 THEN 'use' WHEN 3 THEN 'disagree' WHEN 4 THEN 'key' ELSE lang END",
        "found": "CASE WHEN doc_id % 9 = 4 THEN NULL ELSE 'moved' END", "note": "text", "quote": "text || text || text", "prefix": "substr(text, 1, 28 + doc_id % 6)", "suffix": "source",
        "place": "CASE WHEN doc_id % 13 = 1 THEN CAST('NaN' AS DOUBLE) WHEN doc_id % 13 = 2 THEN CAST('infinity' AS DOUBLE) ELSE CAST(doc_id AS DOUBLE) END",
        "tail": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE substr(text, 1, 30 + doc_id % 5) END",
    },
    HIGHLIGHT, "VAL-01: records of highlights.",
)
GROUP = [("id", "group.id", "gid IS NOT NULL AND gid <> ''"), ("name", "group.name", "length(name) BETWEEN 1 AND 80")]
checked("validated_groups", "part", ["p_partkey"], {"gid": "CASE WHEN p_partkey % 19 = 5 THEN '' ELSE p_brand END", "name": "CASE WHEN p_partkey % 23 = 7 THEN '' WHEN p_partkey % 23 = 8 THEN p_name || p_name || p_name || p_type || p_name || p_type ELSE p_name END"}, GROUP, "VAL-02: groups of notes.")
REQUEST = [
    ("question", "question", "trim(question) <> '' AND length(question) <= 4000"), ("quote", "quote", "length(quote) <= 2000"), ("quotes", "quotes", "n_quotes <= 4"),
    ("added quote", "quotes.quote", "n_quotes = 0 OR length(added) BETWEEN 1 AND 2000"),
]
checked(
    "validated_requests", "conversations", ["conv_id", "turn"],
    {"question": "CASE WHEN conv_id % 7 = 0 THEN '  ' WHEN conv_id % 7 = 1 THEN repeat(text, 40) ELSE text END", "quote": "CASE WHEN conv_id % 5 = 0 THEN repeat(text, 20) ELSE text END", "n_quotes": "turn", "added": "CASE WHEN turn = 1 THEN '' ELSE role END"},
    REQUEST, "VAL-16: limits of chat requests.",
)
SETTINGS = [
    ("theme", "reading_theme", "theme IN ('system', 'light', 'sepia', 'dark')"), ("margins", "reading_margins", "margins IN ('narrow', 'normal', 'wide')"),
    ("spacing", "reading_spacing", "spacing IN ('compact', 'normal', 'relaxed')"), ("size", "reading_size", "size = floor(size) AND size BETWEEN 15 AND 36"),
    ("effort", "chat_reasoning", "effort IN ('low', 'medium', 'high')"), ("context", "chat_context", "context = floor(context) AND context BETWEEN 2048 AND 2000000"),
]
checked(
    "validated_settings", "orders", ["o_orderkey"],
    {
        "theme": "CASE o_orderstatus WHEN 'F' THEN 'light' WHEN 'O' THEN 'dark' ELSE o_orderstatus END", "margins": "CASE WHEN o_custkey % 31 = 0 THEN 'broad' ELSE 'normal' END",
        "spacing": "CASE WHEN o_custkey % 37 = 0 THEN NULL ELSE 'compact' END", "size": "CASE WHEN o_orderkey % 29 = 0 THEN 20.5 ELSE CAST(10 + o_orderkey % 30 AS DOUBLE) END",
        "effort": "lower(substr(o_orderpriority, 3))", "context": "floor(o_totalprice) * CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 1 END",
    },
    SETTINGS, "VAL-15: ranges and choices of settings.",
)
PATCH = [
    ("state", "state", "state IS NULL OR state IN ('new', 'reading', 'read')"), ("view", "view", "view IS NULL OR view IN ('overview', 'blog', 'paper')"),
    ("anchor", "anchor", "anchor IS NULL OR length(anchor) <= 300"), ("field", "field", "field IN ('state', 'view', 'chapter', 'anchor', 'section')"),
]
checked(
    "validated_patches", "events", ["event_id"],
    {"state": "CASE event_type WHEN 'view' THEN 'reading' WHEN 'purchase' THEN 'read' WHEN 'signup' THEN 'new' WHEN 'click' THEN NULL ELSE event_type END", "view": "CASE WHEN event_id % 10 = 3 THEN 'pdf' WHEN event_id % 2 = 0 THEN 'blog' END",
     "anchor": "repeat(props, CAST(event_id % 40 AS INT))", "field": "CASE WHEN event_id % 25 = 9 THEN 'colour' ELSE 'anchor' END"},
    PATCH, "VAL-17: patches of the reading state.",
)
RETENTION = [
    ("abstract", "abstract", "has_abstract"), ("sections", "sections", "reader_sections >= source_sections"), ("figures", "figures", "reader_figures >= source_figures"),
    ("raw markup", "text", "NOT raw"), ("replacement character", "text", "NOT lost"), ("difference", "epub", "reader_figures = epub_figures"),
]
checked(
    "retention_flags", "pages", ["page_id"],
    {"has_abstract": "contains(html, '<article>')", "source_sections": "length(html) - length(replace(html, '<p>', '12'))", "reader_sections": "length(html) - length(replace(html, '<li>', '123')) + 6", "source_figures": "page_id % 4", "reader_figures": "page_id % 5",
     "epub_figures": "page_id % 3", "raw": "contains(html, '&nbsp;')", "lost": "contains(html, 'footer')"},
    RETENTION, "VAL-18: what a conversion must retain.",
)

_OUTLINE = "CASE WHEN conv_id % 3 = 0 THEN 'fig' || turn END"


@query(f"""
WITH r AS (SELECT conv_id, turn, role, {_OUTLINE} AS figure, text || CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN chr(10) || '{{{{figure:fig' || turn || '}}}}' ELSE '' END || ' [p0000' || turn || '] ' || CASE WHEN turn % 3 = 1 THEN 'a — b – c? Why? the running example' ELSE '' END AS body FROM conversations),
m AS (SELECT *, regexp_extract_all(body, '\\{{\\{{figure:([^}}]+)\\}}\\}}', 1) AS markers, regexp_extract_all(body, 'p\\d{{5}}') AS cited,
  len(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(body, '\\{{\\{{figure:[^}}]+\\}}\\}}', '', 'g'), ' ?\\[(?:p\\d{{5}}(?:, ?)?)+\\]', '', 'g')), '\\s+'), lambda w: w <> '')) AS words FROM r)
SELECT conv_id, turn, unnest(list_filter([CASE WHEN markers <> CASE WHEN figure IS NULL THEN [] ELSE [figure] END THEN 'markers' END, CASE WHEN len(cited) = 0 OR cited[1] > 'p00004' THEN 'citations' END,
  CASE WHEN words > 52 THEN 'words' END, CASE WHEN regexp_matches(lower(body), '\\brunning example\\b') THEN 'example' END, CASE WHEN len(regexp_extract_all(body, '[?]')) > 1 THEN 'questions' END,
  CASE WHEN regexp_matches(body, '—|\\s–\\s') THEN 'dashes' END], lambda x: x IS NOT NULL)) AS rule FROM m""")
def validated_sections(spark, d):
    """VAL-12: markers, citations, the word ceiling of 1.3 times the target, the example's name, questions, dashes."""
    rows = load(spark, d, "conversations")
    turn = F.col("turn").cast("string")
    figure = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("fig"), turn))
    marker = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 0), F.concat(F.lit("\n{{figure:fig"), turn, F.lit("}}"))).otherwise("")
    body = F.concat("text", marker, F.lit(" [p0000"), turn, F.lit("] "), F.when(F.col("turn") % 3 == 1, "a — b – c? Why? the running example").otherwise(""))
    rows = rows.select("conv_id", "turn", figure.alias("figure"), body.alias("body"))
    markers = F.regexp_extract_all("body", F.lit(r"\{\{figure:([^}]+)\}\}"), F.lit(1))
    wanted = F.when(F.col("figure").isNull(), F.array().cast("array<string>")).otherwise(F.array("figure"))
    cited = F.regexp_extract_all("body", F.lit(r"p\d{5}"), F.lit(0))
    plain = F.regexp_replace(T.uncited(F.regexp_replace("body", r"\{\{figure:[^}]+\}\}", "")), "^$", "")
    found = rules.issues(rows, ["conv_id", "turn"], [
        rules.Rule("markers", "body", markers == wanted), rules.Rule("citations", "body", (F.size(cited) > 0) & (F.get(cited, 0) <= "p00004")),
        rules.Rule("words", "body", T.word_count(plain) <= int(40 * 1.3)), rules.Rule("example", "body", ~F.lower("body").rlike(r"\brunning example\b")),
        rules.Rule("questions", "body", F.regexp_count("body", F.lit("[?]")) <= 1), rules.Rule("dashes", "body", ~F.col("body").rlike(r"—|\s–\s")),
    ])
    return found.select("conv_id", "turn", "rule")


_REFS = "SELECT conv_id, unnest([turn, turn, turn * 2, 9 - turn]) AS ref FROM conversations"


@query(f"""
WITH q AS ({_REFS}), r AS (SELECT q.conv_id, q.ref, k.turn IS NOT NULL AS known, count(*) OVER (PARTITION BY q.conv_id, q.ref) AS n FROM q LEFT JOIN conversations k ON k.conv_id = q.conv_id AND k.turn = q.ref AND k.role = 'user'),
s AS (SELECT conv_id, bool_or(n > 1) AS twice, bool_or(NOT known) AS unknown, count(DISTINCT CASE WHEN known THEN ref END) AS resolved FROM r GROUP BY conv_id)
SELECT conv_id, rule FROM (SELECT conv_id, unnest([CASE WHEN twice THEN 'unique' END, CASE WHEN unknown THEN 'known' END, CASE WHEN resolved < 2 THEN 'resolves' END]) AS rule FROM s) WHERE rule IS NOT NULL""")
def validated_selections(spark, d):
    """VAL-04, VAL-05: selected ids are unique and known, and enough of them resolve."""
    rows = load(spark, d, "conversations")
    refs = rows.select("conv_id", F.explode(F.array(F.col("turn"), F.col("turn"), F.col("turn") * 2, 9 - F.col("turn"))).alias("ref"))
    counted = refs.groupBy("conv_id", "ref").agg(F.count(F.lit(1)).alias("n"))
    known = rows.where("role = 'user'").select("conv_id", F.col("turn").alias("ref"), F.lit(True).alias("known")).distinct()
    sums = counted.join(known, ["conv_id", "ref"], "left").groupBy("conv_id").agg(F.max("n").alias("most"), F.count("known").alias("resolved"), F.count(F.lit(1)).alias("refs"))
    found = rules.issues(sums, ["conv_id"], [rules.Rule("unique", "ids", F.col("most") == 1), rules.Rule("known", "ids", F.col("resolved") == F.col("refs")), rules.Rule("resolves", "ids", F.col("resolved") >= 2)])
    return found.select("conv_id", "rule")


@query("""
WITH n AS (SELECT o_custkey AS g, count(*) AS k FROM orders GROUP BY 1), e AS (SELECT o_custkey AS g, o_orderkey AS a, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey WHEN o_orderkey % 5 = 0 THEN -1 ELSE lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS b FROM orders),
x AS (SELECT g, count(*) FILTER (a = b) AS own, count(*) FILTER (b = -1) AS unknown FROM e GROUP BY g)
SELECT g, unnest(list_filter([CASE WHEN k NOT BETWEEN 4 AND 24 THEN 'components' END, CASE WHEN own > 0 THEN 'self edge' END, CASE WHEN unknown > 0 THEN 'unknown edge' END], lambda r: r IS NOT NULL)) AS rule FROM n JOIN x USING (g)""")
def validated_digests(spark, d):
    """VAL-06: 4 to 24 components, edges to known components, none to itself."""
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("a"))
    after = F.lead("a").over(Window.partitionBy("g").orderBy("a"))
    edges = orders.withColumn("b", F.when(F.col("a") % 7 == 0, F.col("a")).when(F.col("a") % 5 == 0, -1).otherwise(after))
    nodes = orders.select("g", F.col("a").alias("b"), F.lit(True).alias("known"))
    sums = edges.join(nodes, ["g", "b"], "left").groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("a") == F.col("b")).alias("own"), F.count_if(F.col("b").isNotNull() & F.col("known").isNull()).alias("unknown"))
    found = rules.issues(sums, ["g"], [rules.Rule("components", "components", F.col("k").between(4, 24)), rules.Rule("self edge", "edges", F.col("own") == 0), rules.Rule("unknown edge", "edges", F.col("unknown") == 0)])
    return found.select("g", "rule")


@query(r"""
WITH r AS (SELECT conv_id, turn, list_sort(regexp_extract_all(text, '\b[a-z]{9,}\b')) AS a, list_sort(regexp_extract_all(CASE WHEN turn % 4 = 3 THEN replace(text, 'tion', 'sion') ELSE text END, '\b[a-z]{9,}\b')) AS b FROM conversations)
SELECT conv_id, turn FROM r WHERE a <> b""")
def markers_after_edits(spark, d):
    """VAL-13: the markers of a text before and after its edits are equal as multisets."""
    # The edges of a word are those of ASCII, in both engines; Java's own take letters of any script.
    marks = lambda x: F.array_sort(F.regexp_extract_all(x, F.lit(r"(?<![0-9A-Za-z_])[a-z]{9,}(?![0-9A-Za-z_])"), F.lit(0)))
    edited = F.when(F.col("turn") % 4 == 3, F.replace("text", F.lit("tion"), F.lit("sion"))).otherwise(F.col("text"))
    return load(spark, d, "conversations").where(marks(F.col("text")) != marks(edited)).select("conv_id", "turn")
