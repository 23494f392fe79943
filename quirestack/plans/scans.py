"""Scanners and samples over whole documents, in which some words stand for braces, formulas and row breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scan
from ..operators import sampling
from ..sources import markup
from ..tables import load

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _replaced(x, pairs):
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def _duck(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


# What some words of the documents stand for.
BRACES = [(" the ", " {the "), (" of ", " of} "), (" in ", " \\{in "), ("and", "\\\\{and"), (".", "}")]
DOLLARS = [("$", ""), (" the ", " $x "), (" of ", " y$ "), (" in ", " \\$in ")]
ROWS = [(" the ", " \\\\the "), (" of ", " {of "), (" in ", " in} "), (" and ", " \\begin{a} ")]


@query(rf"""
WITH r AS (SELECT doc_id, {_duck('text', BRACES)} AS x FROM documents),
t AS (SELECT doc_id, list_prepend('', regexp_extract_all(x, '\\.|[{{}}]')) AS m, string_split_regex(x, '\\.|[{{}}]') AS g FROM r),
s AS (SELECT doc_id, unnest(m) AS tok, unnest(list_transform(g, lambda y: length(y)::BIGINT)) AS gap, generate_subscripts(m, 1) AS k FROM t),
p AS (SELECT doc_id, tok, k, sum(gap + length(tok)) OVER (PARTITION BY doc_id ORDER BY k) - gap - length(tok) AS spot FROM s),
b AS (SELECT doc_id, tok, spot, sum(CASE tok WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY k) AS depth FROM p WHERE tok IN ('{{', '}}')),
l AS (SELECT *, CASE tok WHEN '{{' THEN depth ELSE depth + 1 END AS level FROM b),
n AS (SELECT doc_id, tok, spot, level, lead(tok) OVER w AS next, lead(spot) OVER w AS stop FROM l WINDOW w AS (PARTITION BY doc_id, level ORDER BY spot)),
q AS (SELECT doc_id, spot AS start, stop FROM n WHERE tok = '{{' AND next = '}}')
SELECT doc_id, start::INT AS start, stop::INT AS stop, (count(*) OVER (PARTITION BY doc_id ORDER BY start) - (SELECT count(*) FROM q e WHERE e.doc_id = q.doc_id AND e.stop < q.start))::INT AS depth FROM q""")
def brace_spans(spark, d):
    """STR-30: every balanced pair of braces and how deep it stands; escaped braces are text."""
    rows = load(spark, d, "documents").select("doc_id", F.explode(scan.brace_spans(_replaced(F.col("text"), BRACES))).alias("s"))
    return rows.select("doc_id", "s.*")


@query(rf"""
WITH r AS (SELECT doc_id, {_duck('text', DOLLARS)} AS x FROM documents),
t AS (SELECT doc_id, list_prepend('', regexp_extract_all(x, '\\.|\$')) AS m, string_split_regex(x, '\\.|\$') AS g FROM r),
s AS (SELECT doc_id, unnest(m) AS tok, unnest(list_transform(g, lambda y: length(y)::BIGINT)) AS gap, generate_subscripts(m, 1) AS k FROM t),
p AS (SELECT doc_id, tok, k, sum(gap + length(tok)) OVER (PARTITION BY doc_id ORDER BY k) - gap - length(tok) AS spot FROM s),
d AS (SELECT doc_id, spot, row_number() OVER w AS n, lead(spot) OVER w AS stop FROM p WHERE tok = '$' WINDOW w AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, spot::INT AS start, (stop + 1)::INT AS stop FROM d WHERE n % 2 = 1 AND stop IS NOT NULL""")
def math_spans(spark, d):
    """STR-31: formulas between dollars; escaped dollars are text."""
    rows = load(spark, d, "documents").select("doc_id", F.explode(scan.math_spans(_replaced(F.col("text"), DOLLARS))).alias("s"))
    return rows.select("doc_id", "s.*")


@query(rf"""
WITH r AS (SELECT doc_id, {_duck('text', ROWS)} AS x FROM documents),
t AS (SELECT doc_id, list_prepend('', regexp_extract_all(x, '\\begin\s*\{{[^}}]*\}}|\\\\|\\[{{}}]|[{{}}]')) AS m, string_split_regex(x, '\\begin\s*\{{[^}}]*\}}|\\\\|\\[{{}}]|[{{}}]') AS g FROM r),
s AS (SELECT doc_id, unnest(m) AS tok, unnest(g) AS gap, generate_subscripts(m, 1) AS k FROM t),
c AS (SELECT doc_id, tok, gap, k, sum(CASE WHEN tok = '{{' OR tok LIKE '\begin%' THEN 1 WHEN tok = '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS depth FROM s),
g AS (SELECT *, CASE WHEN tok = '\\' AND depth = 0 THEN 1 ELSE 0 END AS cut FROM c),
n AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM g)
SELECT doc_id, pos::INT AS pos, string_agg(CASE WHEN cut = 1 THEN gap ELSE tok || gap END, '' ORDER BY k) AS part FROM n GROUP BY doc_id, pos""")
def top_rows(spark, d):
    """STR-32: rows of alignments, parted at their own breaks only."""
    return load(spark, d, "documents").select("doc_id", F.posexplode(scan.alignment_rows(_replaced(F.col("text"), ROWS))).alias("pos", "part"))


_QUOTED = [(" the ", " $x + y$ ")]
_MOD = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({h}), 2), lambda i: ('0x' || substr({h}, i, 2))::BIGINT)), lambda a, b: (a * 256 + b) % {n})"


@query(rf"""
WITH ls AS (SELECT doc_id, unnest(string_split({_duck('text', _QUOTED)}, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
u AS (SELECT doc_id, pos, t, sha1(doc_id || ':' || pos) AS h, regexp_extract_all(t, '\$[^$]*\$|[^\s$]+') AS m, string_split_regex(t, '\$[^$]*\$|[^\s$]+') AS g FROM ls WHERE length(t) >= 40),
n AS (SELECT *, len(m) AS n, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x)::BIGINT)) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x)::BIGINT)), 0)) AS st, list_filter(range(0, len(m)), lambda i: starts_with(m[i + 1], '$')) AS f FROM u WHERE len(m) >= 6),
c AS (SELECT *, least(6 + {_MOD.format(h='h', n='10')}, n) AS c1, least(6 + {_MOD.format(h='h[1:36]', n='10')}, n) AS c2, CASE WHEN len(f) > 0 THEN f[1 + {_MOD.format(h='h[1:38]', n='len(f)')}] END AS spot FROM n),
a AS (SELECT *, least(n, greatest(0, n // 2 - c1 // 2) + c1) - c1 AS a1, greatest(0, least(spot - {_MOD.format(h='h[1:34]', n='c2')}, n - c2)) AS a2 FROM c),
e AS (SELECT doc_id, pos, 0 AS n, t, st[a1 + 1] AS b, st[a1 + c1] + length(m[a1 + c1]) AS e FROM a UNION ALL SELECT doc_id, pos, 1, t, st[a2 + 1], st[a2 + c2] + length(m[a2 + c2]) FROM a WHERE spot IS NOT NULL AND NOT (a1 = a2 AND c1 = c2))
SELECT doc_id, pos::INT AS pos, n, substr(t, b::BIGINT + 1, (e - b)::BIGINT) AS quote, substr(t, greatest(b - 32, 0)::BIGINT + 1, least(b, 32)::BIGINT) AS before, substr(t, e::BIGINT + 1, 32) AS after FROM e""")
def sampled_quotes(spark, d):
    """SMP-02: quotes of every passage, drawn from the passage's digest."""
    rows = load(spark, d, "documents").select("doc_id", F.posexplode(F.split(_replaced(F.col("text"), _QUOTED), "\n")).alias("pos", "text"))
    return sampling.sampled_quotes(rows, "doc_id", "pos")


@query()
def anchor_regression(spark, d):
    """DIF-06: quotes sampled from every document of which its next version has lost the words; every seventh document lost a third of its lines."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    quotes = sampling.sampled_quotes(lines, "doc_id", "pos").withColumn("near", F.col("pos").cast("double"))
    after = lines.where("NOT (doc_id % 7 = 0 AND pos % 3 = 1)").withColumn("spot", F.col("pos"))
    return sampling.lost_quotes(quotes, after, "doc_id", "pos", "spot")


# ---- nested documents ------------------------------------------------------------------------------
def _article(spark, d):
    """(doc_id, html): documents as articles, a section for each line, ids that meet again inside and beside each other."""
    text = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("$"), F.lit(""))
    part = lambda x, k: F.concat(
        F.lit('<section id="s'), (k % 3).cast("string"), F.lit('"><h2>Part '), k.cast("string"), F.lit('</h2><p class="'), F.when(k == 0, "abstract").otherwise("body"), F.lit('" id="p '), (k % 2).cast("string"),
        F.lit('">'), x, F.lit(' <math alttext="x_'), k.cast("string"), F.lit('"><mi>x</mi></math></p></section>'),
    )
    html = F.concat(F.lit('<article id="s1"><p>Begin</p>'), F.array_join(F.transform(F.split(text, "\n"), part), ""), F.lit("</article>"))
    return load(spark, d, "documents").select("doc_id", html.alias("html"))


_PARTS = r"""p AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), '$', ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
t AS (SELECT doc_id, k, trim(regexp_replace(x || ' $x_' || k || '$ ', '[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{3000}]+', ' ', 'g')) AS x FROM p)"""


@query(f"""WITH {_PARTS}, n AS (SELECT doc_id, max(k) AS top FROM t GROUP BY doc_id),
e AS (SELECT doc_id, 0 AS pre, 'article' AS tag, 's1' AS id, 's1' AS new_id FROM n
 UNION ALL SELECT t.doc_id, 2 + 5 * k, 'section', 's' || (k % 3), CASE WHEN k % 3 = 1 THEN NULL WHEN k + 3 > top THEN 's' || (k % 3) ELSE 's' || (k % 3) || '-duplicate-' || (k // 3 + 1) END FROM t JOIN n USING (doc_id)
 UNION ALL SELECT t.doc_id, 4 + 5 * k, 'p', 'p ' || (k % 2), 'anchor-' || substr(sha256(CASE WHEN k + 2 > top THEN 'p ' || (k % 2) ELSE 'p ' || (k % 2) || '-duplicate-' || (k // 2 + 1) END), 1, 20) FROM t JOIN n USING (doc_id))
SELECT doc_id, pre::INT AS pre, tag, id, new_id, false AS conflict FROM e""")
def resolved_ids(spark, d):
    """DOC-04: ids that several elements share: the outer one keeps it, then the last; earlier ones get a suffix, inner ones none."""
    rows = markup.resolved_ids(markup.elements(_article(spark, d), "doc_id", texts={"span"}), "doc_id")
    return rows.where("id IS NOT NULL").select("doc_id", "pre", "tag", "id", "new_id", "conflict")


@query(f"""WITH {_PARTS} SELECT doc_id, (2 + 5 * k)::INT AS section, 0 AS parent, 'Part ' || k AS title, 2 AS passages, length(x) + length('Part ' || k) AS chars FROM t
UNION ALL SELECT DISTINCT doc_id, 0, NULL, NULL, 1, 5 FROM t""")
def outlined_sections(spark, d):
    """DOC-06: sections of nested documents with their structural parents, titles, passages and characters."""
    return markup.sections(markup.elements(_article(spark, d), "doc_id", texts={"p", "h2"}), "doc_id", ["p", "h2"])


@query(f"""WITH {_PARTS} SELECT doc_id, 'identified' AS status, [x] AS texts FROM t WHERE k = 0""")
def abstract_states(spark, d):
    """DOC-01, DOC-02, DOC-06: the passages inside what is marked as the abstract, formulas as their source."""
    return markup.abstracts(markup.elements(_article(spark, d), "doc_id", texts={"p", "h2"}), "doc_id", ["p", "h2"])


@query("""
SELECT page_id, true AS fixed, false AS active, 4 + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS refused FROM pages""")
def safe_pages(spark, d):
    """DOC-03: pages with planted scripts, handlers, frames and links to programs are made safe, once and for all."""
    planted = F.when(F.col("page_id") % 2 == 0, '<a href=" java\tscript:run()">x</a>').otherwise('<a href="doi:10.1/x">y</a>')
    html = F.concat(F.lit('<p onclick="run()">a</p><iframe srcdoc="<p>"></iframe><img src="https://far/x.png"><object data="x">gone</object>'), planted, F.regexp_replace("html", "(?s)<script.*?</script>", ""))
    once = load(spark, d, "pages").select("page_id", markup.rewritten(html).alias("a"))
    twice = once.select("page_id", "a", markup.rewritten(F.col("a.html")).alias("b"))
    active = F.col("a.html").rlike(r"(?is)<(script|iframe|object|embed|form|input|button|base)\b|<[^>]*\s(on\w+|srcdoc)=|javascript:")
    return twice.select("page_id", (F.col("a.html") == F.col("b.html")).alias("fixed"), active.alias("active"), F.size("a.refused").alias("refused"))
