"""Queries over what users and papers write: links, ids, names, sentences, tables, edits, references.

Where no table holds such a text, one is made of its columns, in both engines alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import inputs as I
from ..functions import text as T
from ..operators import matching, rules
from ..sources import html
from ..tables import load

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: An id of a paper for each order, written the same in both engines.
_ID = "lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || '.' || lpad(CAST(o_custkey % 100000 AS STRING), 5, '0') || 'v' || CAST(o_orderkey % 3 + 1 AS STRING)"
_LINK = f"""CASE o_orderkey % 9 WHEN 0 THEN 'https://arxiv.org/abs/' || {_ID} WHEN 1 THEN 'http://arxiv.org/abs/' || {_ID} WHEN 2 THEN ' ' || {_ID} WHEN 3 THEN 'https://www.alphaxiv.org/overview%2F' || replace({_ID}, '.', '%2E')
  WHEN 4 THEN 'https://example.org/abs/' || {_ID} WHEN 5 THEN 'https://arxiv.org/pdf/' || {_ID} || '.pdf' WHEN 6 THEN 'https://paperswithcode.com/paper/x' WHEN 7 THEN 'https://huggingface.co/papers/' || {_ID} || '/' ELSE 'https://arxiv.org/list/' || {_ID} END"""


@query(f"""
WITH r AS (SELECT o_orderkey, {_LINK} AS x, {_ID} AS id FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 2, 3, 5, 7) THEN id END AS id, CASE o_orderkey % 9 WHEN 1 THEN 'not a paper link' WHEN 4 THEN 'not a paper link' WHEN 6 THEN 'search by title' WHEN 8 THEN 'no identifier' END AS reason FROM r""")
def paper_links(spark, d):
    """STR-06: the id that a link names, or why it names none."""
    return load(spark, d, "orders").selectExpr("o_orderkey", f"{_LINK} AS x").select("o_orderkey", I.paper_link(F.col("x")).alias("p")).select("o_orderkey", "p.*")


@query(f"""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'hep-th/' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || '001' ELSE {_ID} END AS id FROM orders),
p AS (SELECT *, CAST(substr(regexp_replace(id, '^hep-th/', ''), 1, 2) AS INT) AS yy, CAST(substr(regexp_replace(id, '^hep-th/', ''), 3, 2) AS INT) AS mm FROM r),
y AS (SELECT *, yy + CASE WHEN id LIKE 'hep-th/%' AND yy > 90 THEN 1900 ELSE 2000 END AS year FROM p)
SELECT o_orderkey, year, mm AS month, year * 100 + mm AS key, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][mm] || ' ' || year AS label FROM y WHERE mm BETWEEN 1 AND 12""")
def paper_dates(spark, d):
    """STR-07: the month an id tells."""
    old = "CASE WHEN o_orderkey % 4 = 0 THEN 'hep-th/' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || '001' ELSE " + _ID + " END"
    rows = load(spark, d, "orders").selectExpr("o_orderkey", f"{old} AS id").select("o_orderkey", I.paper_date(F.col("id")).alias("p"))
    return rows.where("p IS NOT NULL").select("o_orderkey", "p.*")


_AUTHORS = "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN 'Ada de ' || c_mktsegment WHEN 3 THEN c_mktsegment || ', A, ' || c_name || ', B' ELSE c_name || ', A, ' || c_mktsegment || ', B, Last, C' END"


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment WHEN 3 THEN c_mktsegment || ' and ' || c_name ELSE c_name || ' et al.' END AS byline,
  CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN [c_name] WHEN 2 THEN ['Ada de ' || c_mktsegment] WHEN 3 THEN ['A ' || c_mktsegment, 'B ' || c_name] ELSE ['A ' || c_name, 'B ' || c_mktsegment, 'C Last'] END AS names FROM customer""")
def author_bylines(spark, d):
    """STR-08: names and bylines of 'Last, First, ...' strings."""
    return load(spark, d, "customer").selectExpr("c_custkey", f"{_AUTHORS} AS a").select("c_custkey", I.byline(F.col("a")).alias("byline"), I.author_names(F.col("a")).alias("names"))


@query(r"""
WITH s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS s FROM documents)
SELECT doc_id, count(*) AS sentences, max(length(s)) AS longest, count(*) FILTER (regexp_matches(s, '(?i)\b(token|term|word)(?:e?s)?\b')) AS uses, count(*) FILTER (regexp_matches(s, '(?i)^(?:(?:a|an|the)\s+)?model(?:e?s)?\s+(?:is|are|means|refers to)\b')) AS explained FROM s GROUP BY doc_id""")
def sentence_terms(spark, d):
    """STR-14..16: sentences, those that use terms, those that explain one."""
    rows = load(spark, d, "documents").select("doc_id", F.explode(I.sentences(F.col("text"))).alias("s"))
    uses = F.lit(False)
    for term in ("token", "term", "word"):
        uses = uses | F.col("s").rlike(I.term_pattern(term))
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.max(F.length("s")).cast("long").alias("longest"), F.count_if(uses).alias("uses"), F.count_if(I.explains(F.col("s"), "model")).alias("explained")
    )


@query("""
WITH r AS (SELECT doc_id, replace(replace(replace(text, ' the ', ' – '), ' in ', '—'), 'ndo', '–o') || ' 770–778' AS x FROM documents),
p AS (SELECT doc_id, x, string_split_regex(x, '[—–]') AS p FROM r),
s AS (SELECT doc_id, x, p, list_transform(p, lambda y: length(y)::BIGINT) AS n FROM p),
u AS (SELECT doc_id, x, p, unnest(range(1, len(p))) AS k, unnest(list_transform(range(1, len(p)), lambda k: list_sum(n[1:k]) + k)) AS i FROM s),
m AS (SELECT doc_id, x, i::BIGINT AS i, substr(x, i::BIGINT, 1) AS c, right(CASE WHEN p[k] = '' AND k > 1 THEN '–' ELSE p[k] END, 1) AS l, left(p[k + 1], 1) AS n FROM u),
k AS (SELECT *, c = '–' AND regexp_matches(l, '^\\s$') AND regexp_matches(n, '^\\s$') AS spaced FROM m WHERE c = '—' OR (regexp_matches(l, '^\\s$') AND regexp_matches(n, '^\\s$')) OR (i > 1 AND regexp_matches(l, '^\\p{L}$')) OR regexp_matches(n, '^\\p{L}$'))
SELECT doc_id, substr(x, greatest(1, i - 30 - spaced::INT), least(30, i - 1 - spaced::INT) + 31 + 2 * spaced::INT) AS near FROM k""")
def dash_contexts(spark, d):
    """STR-17: dashes that are punctuation, in their context, over whole documents."""
    dashed = F.replace(F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" – ")), F.lit(" in "), F.lit("—")), F.lit("ndo"), F.lit("–o"))
    return load(spark, d, "documents").select("doc_id", F.explode(I.dashes(F.concat(dashed, F.lit(" 770–778")))).alias("near"))


@query("""
SELECT p_partkey, [p_brand, '`a|b` ' || p_size, 'P(y|x)', CAST(p_size AS VARCHAR)] AS cells, [false, false, false, true] AS numeric FROM part""")
def table_rows(spark, d):
    """STR-18, STR-19: cells of Markdown rows and which are numbers."""
    row = F.concat(F.lit("| "), F.col("p_brand"), F.lit(" | `a|b` "), F.col("p_size").cast("string"), F.lit(" | P(y\\|x) | "), F.col("p_size").cast("string"), F.lit(" |"))
    cells = load(spark, d, "part").select("p_partkey", I.table_cells(row).alias("cells"))
    return cells.select("p_partkey", "cells", F.transform("cells", I.is_number).alias("numeric"))


@query("""
WITH r AS (SELECT doc_id, string_split(lower(text), 'the') AS p FROM documents), e AS (SELECT doc_id, len(p) - 1 AS n, [list_sum([length(y) for y in p[1:i]]) + (i - 1) * 3 + 1 for i in range(1, len(p))] AS spots FROM r)
SELECT doc_id, n AS hits, spots[1]::BIGINT AS first, coalesce(list_filter(spots, lambda x: x > 200)[1], spots[1])::BIGINT AS below FROM e WHERE n > 0""")
def found_in_text(spark, d):
    """STR-21: how often a query is found, where first, and where first below a position, from the top again where there is none."""
    rows = load(spark, d, "documents").select("doc_id", I.occurrences(F.col("text"), "the").alias("at")).where(F.size("at") > 0)
    below = F.coalesce(F.get(F.filter("at", lambda x: x > 200), 0), F.get("at", 0))
    return rows.select("doc_id", F.size("at").cast("long").alias("hits"), F.get("at", 0).cast("long").alias("first"), below.cast("long").alias("below"))


_RAISED = "CASE event_id % 7 WHEN 0 THEN 'native/host.py:12 extract_source' WHEN 1 THEN 'native/host.py:9 prepare_x' WHEN 2 THEN 'papers/document.py:3 build' WHEN 3 THEN 'papers/worker.py:7 run' WHEN 4 THEN 'native/host.py:1 convert_source' WHEN 5 THEN 'a arxiv_html b' ELSE event_type END"
_ERROR = "CASE event_id % 5 WHEN 0 THEN 'HTTP status 503 timed out' WHEN 1 THEN 'HTTP status 401 timed out' WHEN 2 THEN 'Authentication timed out' WHEN 3 THEN 'connection reset' ELSE 'bad input' END"


@query(f"""
SELECT event_id, ['extract', 'pass', 'document', 'latexml', 'pandoc', 'arxiv-html', 'unknown'][event_id % 7 + 1] AS stage, event_id % 5 IN (0, 3) AS again FROM events""")
def failure_stages(spark, d):
    """STR-26, FLT-11: the stage that failed, and whether another try may help."""
    rows = load(spark, d, "events").selectExpr("event_id", f"{_RAISED} AS raised", f"{_ERROR} AS error")
    return rows.select("event_id", I.stage_of(F.col("raised")).alias("stage"), I.is_transient(F.col("error"), ["timed out", "connection reset"]).alias("again"))


@query("""
SELECT o_orderkey, 'attachment; filename="' || o_orderpriority || ' caf_ ' || o_orderstatus || '"; filename*=UTF-8''''' || replace(o_orderpriority, ' ', '%20') || '%20caf%C3%A9%20' || o_orderstatus AS header FROM orders""")
def attachment_names(spark, d):
    """STR-36: names of downloads."""
    name = F.concat(F.col("o_orderpriority"), F.lit(" café/"), F.col("o_orderstatus"), F.lit('"\n'))
    return load(spark, d, "orders").select("o_orderkey", I.attachment(name).alias("header"))


@query("""
WITH r AS (SELECT doc_id, text, substr(text, 5, 12) AS a, substr(text, 40, 9) AS b FROM documents),
c AS (SELECT *, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(a)) = a)) AS na, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(b)) = b)) AS nb FROM r WHERE length(text) BETWEEN 60 AND 2000)
SELECT doc_id, CASE WHEN na = 1 AND nb = 1 THEN md5(substr(text, 1, 4) || '<A>' || substr(text, 17, 23) || '<B>' || substr(text, 49)) END AS digest FROM c""")
def article_edits(spark, d):
    """STR-38: edits of texts that stand exactly once, made at once."""
    edits = F.array(F.struct(F.substring("text", 40, 9).alias("old"), F.lit("<B>").alias("new")), F.struct(F.substring("text", 5, 12).alias("old"), F.lit("<A>").alias("new")))
    rows = load(spark, d, "documents").where(F.length("text").between(60, 2000))
    return rows.select("doc_id", F.md5(I.applied(F.col("text"), edits).cast("binary")).alias("digest"))


@query("""
SELECT conv_id, turn, md5(regexp_replace(text, '\n{3,}', '\n\n', 'g') || chr(10) || chr(10) || 'end') AS unmarked, CASE turn % 4 WHEN 0 THEN 'x + ' || turn WHEN 1 THEN 'y' WHEN 2 THEN '$z' ELSE 'w' END AS math, text || '.' AS plain FROM conversations""")
def plain_parts(spark, d):
    """STR-39, STR-42, STR-43: without figure markers, citations, delimiters of mathematics."""
    turn = F.col("turn").cast("string")
    marked = F.concat("text", F.lit("\n\n{{figure:fig1}}\n\nend"))
    math = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("$$x + "), turn, F.lit("$$"))).when(F.col("turn") % 4 == 1, "\\(y\\)").when(F.col("turn") % 4 == 2, "$z").otherwise(" w ")
    cited = F.concat("text", F.lit(" [p00001, p00002]."))
    return load(spark, d, "conversations").select("conv_id", "turn", F.md5(I.unmarked(marked).cast("binary")).alias("unmarked"), I.bare_math(math).alias("math"), T.uncited(cited).alias("plain"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 <> 2 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, event_id % 5 <> 2 AS valid FROM events""")
def fenced_json(spark, d):
    """JSN-01: JSON inside a fence; what doesn't parse is null."""
    raw = F.when(F.col("event_id") % 5 == 2, F.concat(F.lit("```json\n{"), F.col("props"))).when(F.col("event_id") % 5 == 3, F.col("props")).otherwise(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    parsed = F.try_parse_json(I.unfenced(raw))
    return load(spark, d, "events").select("event_id", F.try_variant_get(parsed, "$.k", "int").alias("k"), parsed.isNotNull().alias("valid"))


_ENTRY = "'[' || item_id || '] A. Author and B. Other. ' || substr(text, 1, 60) || '. Press 2001. ' || CASE item_id % 3 WHEN 0 THEN 'arXiv: 2301.0000' || item_id % 10 || 'v2' WHEN 1 THEN 'URL: https://example.org/x' ELSE '' END"


@query(f"""
WITH r AS (SELECT item_id, {_ENTRY} AS x, regexp_replace(regexp_replace({_ENTRY}, '^\\s*\\[\\d+\\]\\s*', ''), '(?i)(?:\\bURL:?\\s+)?\\S*(?:https?://|(?:ar|alpha)xiv\\.org/)\\S*', ' ', 'g') AS e FROM benchmark),
s AS (SELECT *, trim(regexp_replace(e, '\\s+', ' ', 'g')) AS q FROM r), t AS (SELECT *, string_split(regexp_replace(q, '([^\\s.]{{2}})\\.\\s+', '\\1' || chr(1), 'g'), chr(1))[2] AS second FROM s)
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '2301.0000' || item_id % 10 END AS id, left(CASE WHEN len(string_split(second, ' ')) >= 3 THEN second ELSE q END, 300) AS title FROM t""")
def reference_queries(spark, d):
    """REF-04, REF-05: the id a reference names, and what to search for otherwise."""
    entry = F.concat(
        F.lit("["), F.col("item_id").cast("string"), F.lit("] A. Author and B. Other. "), F.substring("text", 1, 60), F.lit(". Press 2001. "),
        F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("arXiv: 2301.0000"), (F.col("item_id") % 10).cast("string"), F.lit("v2"))).when(F.col("item_id") % 3 == 1, "URL: https://example.org/x").otherwise(""),
    )
    return load(spark, d, "benchmark").select("item_id", I.cited_id(entry).alias("id"), I.fallback_title(entry).alias("title"))


@query("""
WITH r AS (SELECT item_id, item_id % 4 AS v, 'https://github.com/o' || item_id || '/r' AS url FROM benchmark)
SELECT item_id, url, 'code' AS kind FROM r WHERE v IN (0, 1) UNION ALL SELECT item_id, 'https://site.example/p', 'project' FROM r WHERE v = 3""")
def own_code_links(spark, d):
    """COD-01..03, COD-06: links with the text before them; the paper's own code, else its project page."""
    k = F.col("item_id")
    v = k % 4
    url = F.concat(F.lit("https://github.com/o"), k.cast("string"), F.lit("/r"))
    link = lambda before, href: F.concat(F.lit(f"{before} <a href=\""), href, F.lit("\">x</a> and more words that follow it, so that the next link stands far behind. "))
    page = F.concat(
        F.lit("<p>"), F.replace(F.replace("text", F.lit("<"), F.lit(" ")), F.lit("&"), F.lit(" ")),
        F.when(v == 0, F.concat(link(". Project page", F.lit("http://site.example/p/")), link("Our code is here", F.concat(url, F.lit(".git")))))
        .when(v == 1, link("An implementation", F.concat(F.lit("https://www."), F.substring(url, 9, 99), F.lit("/tree/main"))))
        .when(v == 2, F.concat(link("An implementation of Smith et al. at", url), F.lit('<section class="ltx_bibliography">'), link("Our code is", url), F.lit("</section>"), link("Our code", F.lit("https://arxiv.org/abs/1"))))
        .otherwise(link("See the project page:", F.lit("https://site.example/p."))),
    )
    rows = html.links(load(spark, d, "benchmark").select("item_id", page.alias("html")), "item_id")
    own = rows.where(~F.col("in_bibliography") & I.own_link(F.col("before"))).select("item_id", "pos", html.code_url(F.col("href")).alias("url")).where("url IS NOT NULL")
    kind = F.when(F.regexp_extract("url", "^https://([^/?]+)", 1).isin(*I.CODE_HOSTS), "code").otherwise("project")
    own = own.withColumn("kind", kind)
    return own.groupBy("item_id").agg(F.min_by(F.struct("url", "kind"), F.struct(F.col("kind") != "code", F.col("pos"))).alias("b")).select("item_id", "b.*")


@query("""
WITH l AS (SELECT p_partkey AS k, 'https://h/' || p_partkey % 3 AS url, CASE WHEN p_partkey % 2 = 0 THEN 'code' ELSE 'project' END AS kind FROM part WHERE p_partkey % 5 <> 0), o AS (SELECT p_partkey AS k, 'https://h/' || p_partkey % 4 AS url, p_size AS stars FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(l.k, o.k) AS k, CASE WHEN o.k IS NULL THEN l.url WHEN l.url = o.url THEN l.url WHEN l.k IS NULL OR l.kind = 'project' THEN o.url ELSE l.url END AS url,
  CASE WHEN o.k IS NULL THEN l.kind WHEN l.url = o.url THEN l.kind WHEN l.k IS NULL OR l.kind = 'project' THEN 'code' ELSE l.kind END AS kind, CASE WHEN o.k IS NULL THEN NULL WHEN l.url = o.url OR l.k IS NULL OR l.kind = 'project' THEN o.stars END AS stars FROM l FULL JOIN o ON l.k = o.k""")
def merged_code(spark, d):
    """COD-05: the official repository adds its stars to the same link, or takes the place of a project page."""
    part = load(spark, d, "part")
    k = F.col("p_partkey")
    local = part.where("p_partkey % 5 <> 0").select(k.alias("k"), F.concat(F.lit("https://h/"), (k % 3).cast("string")).alias("url"), F.when(k % 2 == 0, "code").otherwise("project").alias("kind"))
    official = part.where("p_partkey % 7 <> 0").select(k.alias("k"), F.concat(F.lit("https://h/"), (k % 4).cast("string")).alias("official"), F.col("p_size").alias("stars"))
    both = local.join(official, "k", "full_outer")
    same, takes = F.coalesce(F.col("url") == F.col("official"), F.lit(False)), F.col("official").isNotNull() & (F.col("url").isNull() | (F.col("kind") == "project"))
    return both.select("k", F.when(takes & ~same, F.col("official")).otherwise(F.col("url")).alias("url"), F.when(takes & ~same, "code").otherwise(F.col("kind")).alias("kind"), F.when(same | takes, F.col("stars")).alias("stars"))


@query("""
SELECT item_id, text || chr(10) || 'https://h.example/a/b-c' || item_id || ' end' || chr(10) AS body FROM benchmark""")
def unwrapped_links(spark, d):
    """COD-04: links that a page broke are whole; references are cut."""
    x = F.concat(F.col("text"), F.lit("\nhttps://h.example/a/\nb-\nc"), F.col("item_id").cast("string"), F.lit(" end\nReferences\n[1] https://other.example/x"))
    return load(spark, d, "benchmark").select("item_id", I.unwrapped(x).alias("body"))


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'customer#000000077') AND (SELECT count(*) FROM customer WHERE contains(lower(c_name), 'customer#000000077')) = 1""")
def exactly_one_title(spark, d):
    """FLT-03: the row whose title holds the query, if it is the only one."""
    hits = load(spark, d, "customer").where(F.contains(F.lower("c_name"), F.lit("customer#000000077"))).select("c_custkey", "c_name")
    return hits.limit(2).groupBy().agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("c_custkey", "c_name")).alias("r")).where("n = 1").select("r.*")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND (starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2')) AND regexp_matches(o_orderpriority, '(?i)high|urg') AND NOT (o_custkey % 2 = 1 AND o_totalprice < 1000)""")
def manifest_selection(spark, d):
    """FLT-09, FLT-10: predicates by name, prefix, pattern and trait, combined."""
    named, prefixed = F.col("o_orderstatus").isin("F", "P"), F.exists(F.array(F.lit("1"), F.lit("2")), lambda p: F.startswith("o_orderpriority", p))
    return load(spark, d, "orders").where(named & prefixed & F.col("o_orderpriority").rlike("(?i)high|urg") & ~((F.col("o_custkey") % 2 == 1) & (F.col("o_totalprice") < 1000))).select("o_orderkey")


@query("""SELECT user_id, event_type, props, min(event_id) AS event_id, count(*) - 1 AS repeats FROM events GROUP BY user_id, event_type, props""")
def same_highlights(spark, d):
    """DUP-01: records that agree in place, quote and context are one."""
    return load(spark, d, "events").groupBy("user_id", "event_type", "props").agg(F.min("event_id").alias("event_id"), (F.count(F.lit(1)) - 1).alias("repeats"))


@query("""
WITH u AS (SELECT user_id, list(event_type ORDER BY event_id) AS b FROM events GROUP BY user_id), s AS (SELECT user_id, array_to_string(b, ',') || ',' AS x FROM u)
SELECT user_id, regexp_matches(x, '(^|,)signup,(.*,)?purchase,(.*,)?error,') AS holds FROM s""")
def event_subsequences(spark, d):
    """SUB-01: whether given events happened in this order, others between them."""
    seen = load(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("b"))
    return seen.select("user_id", I.is_subsequence(F.array(*map(F.lit, ("signup", "purchase", "error"))), F.col("b")).alias("holds"))


@query("""
WITH a AS (SELECT item_id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')[1:CASE WHEN item_id % 3 = 0 THEN 3 ELSE 6 END], ' ') AS six FROM benchmark),
w AS (SELECT doc_id, text, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS w FROM documents),
h AS (SELECT a.item_id, min(w.doc_id) AS doc_id FROM a JOIN w ON contains(w.w, ' ' || a.six || ' ') WHERE a.six <> '' GROUP BY a.item_id),
p AS (SELECT h.item_id, h.doc_id, w.text, len(string_split(trim(string_split(w.w, ' ' || a.six || ' ')[1]), ' ')) + CASE WHEN trim(string_split(w.w, ' ' || a.six || ' ')[1]) = '' THEN 0 ELSE 1 END AS n FROM h JOIN w ON w.doc_id = h.doc_id JOIN a ON a.item_id = h.item_id),
l AS (SELECT item_id, doc_id, n, unnest(list_transform(string_split(text, chr(10)), lambda x: len(list_filter(string_split(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), ' '), lambda y: y <> '')))) AS k, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM p),
c AS (SELECT *, sum(k) OVER (PARTITION BY item_id ORDER BY line) AS total FROM l)
SELECT item_id, doc_id, min(line)::BIGINT AS line FROM c WHERE total >= greatest(n, 1) GROUP BY item_id, doc_id""")
def first6_locations(spark, d):
    """NGR-04: the first line at which an anchor's first six words begin, or all of a shorter one; lines may part them."""
    asked = load(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.array_join(F.slice(matching.plain_words(F.col("text")), 1, 3), " ")).otherwise(F.col("text")).alias("text"))
    return matching.first_places(asked, load(spark, d, "documents"), "item_id", "doc_id", "text")


@query("""
SELECT l_orderkey, l_linenumber, floor(l_extendedprice / greatest(l_quantity, 1) * 1000)::BIGINT AS ratio, floor(least(1, 900 / greatest(l_extendedprice, 1)) * 10000)::BIGINT AS scale, 16 * least(1, 900 / greatest(l_extendedprice, 1)) >= 9 AS readable FROM lineitem""")
def shape_checks(spark, d):
    """MTH-03: a figure's ratio, the scale at which it fits (in thousandths and ten-thousandths), whether its letters stay readable."""
    scale = F.least(F.lit(1.0), 900 / F.greatest(F.col("l_extendedprice"), F.lit(1.0)))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") / F.greatest(F.col("l_quantity"), F.lit(1.0)) * 1000).alias("ratio"), F.floor(scale * 10000).alias("scale"), (16 * scale >= 9).alias("readable"))


@query("""
SELECT user_id, event_id, round(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS elapsed, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, floor(epoch(ts))::BIGINT AS seconds FROM events""")
def elapsed_times(spark, d):
    """DT-01, DT-04: seconds since the event before, to three decimals, and ISO stamps."""
    from pyspark.sql import Window

    exact = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("user_id", "event_id", F.round(exact - F.lag(exact).over(w), 3).alias("elapsed"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.floor(exact).cast("long").alias("seconds"))


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS old, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn = 2 THEN -1 ELSE turn END) AS new FROM conversations)
SELECT conv_id, turn, old, new FROM r WHERE old <> new""")
def renumbered_after_move(spark, d):
    """ARR-02: a record moved to the front; only rows whose number changes are written."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("old"), F.row_number().over(w.orderBy(F.when(F.col("turn") == 2, -1).otherwise(F.col("turn")))).alias("new"))
    return rows.where("old <> new")


@query("""
SELECT o_orderkey, '$.a.s' AS path, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, '$.a.p[0]', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, '$.a.p[1]', 'x' FROM orders""")
def flattened_trees(spark, d):
    """ARR-03: the strings of a nested value with their paths."""
    tree = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("s"), F.array(F.col("o_orderpriority"), F.lit("x")).alias("p"), F.col("o_custkey").alias("n")).alias("a")))
    return rules.flattened(load(spark, d, "orders").select("o_orderkey", tree.alias("j")), ["o_orderkey"], "j")


@query("""
WITH r AS (SELECT conv_id, list(text ORDER BY turn) AS a, list(CASE WHEN turn = conv_id % 5 THEN text || '!' ELSE text END ORDER BY turn) FILTER (turn < 6) AS b FROM conversations GROUP BY conv_id),
p AS (SELECT *, list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])[1] AS spot FROM r)
SELECT conv_id, coalesce(spot - 1, least(len(a), len(b)))::BIGINT AS pos, a[coalesce(spot, least(len(a), len(b)) + 1)] AS old, b[coalesce(spot, least(len(a), len(b)) + 1)] AS new FROM p WHERE a <> b""")
def first_differences(spark, d):
    """ARR-04: where two arrays differ first."""
    rows = load(spark, d, "conversations")
    ordered = lambda t, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("turn", t.alias("t"))))), lambda x: x["t"])
    spoiled = F.when(F.col("turn") == F.col("conv_id") % 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    both = rows.groupBy("conv_id").agg(ordered(F.col("text"), F.lit(True)).alias("a"), ordered(spoiled, F.col("turn") < 6).alias("b")).where("a <> b")
    shorter = F.least(F.size("a"), F.size("b"))
    at = F.coalesce(F.get(F.filter(F.transform(F.arrays_zip("a", "b"), lambda x, i: F.when(~x["a"].eqNullSafe(x["b"]), i)), lambda i: i.isNotNull()), 0), shorter)
    return both.select("conv_id", at.cast("long").alias("pos"), F.get("a", at).alias("old"), F.get("b", at).alias("new"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'sepia' ELSE 'system' END AS theme, CASE WHEN c_custkey % 2 = 0 THEN '20' ELSE '18' END AS size, sha256(c_name || '/' || c_mktsegment) AS digest FROM customer""")
def settings_with_defaults(spark, d):
    """SRC-04, PRJ-04, PRJ-05: stored values over defaults, where a stored null wins; a digest without volatile keys."""
    k = F.col("c_custkey")
    stored = F.map_from_entries(F.filter(F.array(
        F.when(k % 3 < 2, F.struct(F.lit("theme"), F.when(k % 3 == 1, "sepia"))), F.when(k % 2 == 0, F.struct(F.lit("size"), F.lit("20"))), F.struct(F.lit("unknown"), F.lit("x")),
    ), lambda e: e.isNotNull()))
    known = F.map_filter(stored, lambda key, _: key.isin("theme", "size"))
    value = lambda key, default: F.when(F.map_contains_key(known, key), F.element_at(known, key)).otherwise(default)
    kept = F.map_filter(F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("opened_at"), k.cast("string")), lambda key, _: key != "opened_at")
    return load(spark, d, "customer").select("c_custkey", value("theme", "system").alias("theme"), value("size", "18").alias("size"), F.sha2(F.array_join(F.map_values(kept), "/").cast("binary"), 256).alias("digest"))
