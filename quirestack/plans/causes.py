"""Normal forms of model answers, templates of papers, causes of failed conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import inputs as I
from ..functions import tex as X
from ..operators import nested as N
from ..operators import prose as P
from ..tables import load, spread
from . import nested as records

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- answers -----------------------------------------------------------------------------------------
def normalized_digest(v: Column) -> Column:
    """A digest with harmless variants of shape taken away: an example given as an object with a text is that text, and no component refers to itself.

    Values of other shapes stay as they are, for the rules to report.
    """

    def component(c: Column) -> Column:
        own = N.string(c, "id")
        kept = lambda refs: F.to_variant_object(F.filter(N.items(refs), lambda x: ~F.coalesce(N.string(x) == own, F.lit(False))))
        member = lambda name, x: F.when(name.isin("contains", "feeds") & (N.kind(x) == "ARRAY"), kept(x)).otherwise(x)
        fields = F.try_variant_get(c, "$", "map<string,variant>")
        return F.when(N.kind(c) == "OBJECT", F.to_variant_object(F.transform_values(fields, member))).otherwise(c)

    text = lambda x: F.when((N.kind(x) == "OBJECT") & N.string(x, "text").isNotNull(), F.try_variant_get(x, "$.text", "variant")).otherwise(x)
    parts = lambda x: F.when(N.kind(x) == "ARRAY", F.to_variant_object(F.transform(N.items(x), component))).otherwise(x)
    field = lambda name, x: F.when(name == "example", text(x)).when(name == "components", parts(x)).otherwise(x)
    return F.when(N.kind(v) == "OBJECT", F.to_variant_object(F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), field))).otherwise(v)


_SPOIL = [(31, 6, '"example":', '"example":{"text":"given"},"instead":'), (13, 1, '"components":[', '"components":["x",'), (17, 2, '"feeds":[', '"feeds":[5,')]
_DIGESTS = f"SELECT doc_id, TRY_CAST({records._spoiled('made', _SPOIL)} AS JSON) AS j FROM (SELECT doc_id, {records._Duck().json(records._digest(records._Duck()))} AS made FROM documents)"


def _refs(name: str) -> str:
    return f"list_transform(list_filter(CASE WHEN json_type(c, '$.{name}') = 'ARRAY' THEN json_extract(c, '$.{name}')::JSON[] ELSE []::JSON[] END, lambda x: NOT coalesce(json_type(x) = 'VARCHAR' AND json_extract_string(x, '$') = json_extract_string(c, '$.id'), false)), lambda x: json_extract_string(x, '$'))"


@query(f"""
WITH d AS ({_DIGESTS}), c AS (SELECT doc_id, j, unnest(json_extract(j, '$.components')::JSON[]) AS c, unnest(range(json_array_length(j, '$.components')::BIGINT)) AS place FROM d)
SELECT doc_id, place::INT AS place, CASE WHEN json_type(j, '$.example') = 'OBJECT' THEN json_extract_string(j, '$.example.text') ELSE json_extract_string(j, '$.example') END AS example, {_refs('contains')} AS contains, {_refs('feeds')} AS feeds FROM c""")
def normalized_digests(spark, d):
    """VAL-07: digests with the example as a text and no component that refers to itself."""
    made = load(spark, d, "documents").selectExpr("doc_id", f"{records._Spark().json(records._digest(records._Spark()))} AS made")
    v = made.select("doc_id", normalized_digest(F.try_parse_json(F.expr(records._spoiled("made", _SPOIL)))).alias("v"))
    rows = v.select("doc_id", "v", F.posexplode(N.items(F.col("v"), "components")).alias("place", "c"))
    refs = lambda name: F.transform(N.items(F.col("c"), name), lambda x: F.try_variant_get(x, "$", "string")).alias(name)
    return rows.select("doc_id", "place", N.string(F.col("v"), "example").alias("example"), refs("contains"), refs("feeds"))


# ---- templates ---------------------------------------------------------------------------------------
# Packages and classes that tell a template, in this order, and what options tell of two classes.
STYLES = [
    (r"neurips_\d+|nips_?\d+", "neurips"), (r"iclr\d+_conference", "iclr"), (r"icml\d+", "icml"), (r"colm\d+_conference", "colm"), (r"tmlr", "tmlr"), (r"jmlr2e", "jmlr2e"),
    (r"acl|acl_natbib|acl\d+|naaclhlt\d+|emnlp\d+", "acl"), (r"cvpr|iccv|wacv", "cvpr"), (r"aaai\d*", "aaai"), (r"ijcai\d+", "ijcai"), (r"interspeech\w*", "interspeech"), (r"spconf", "spconf"),
    (r"usenix\w*", "usenix"), (r"jheppub", "jhep"), (r"jcappub", "jcap"), (r"econometrica", "econometrica"),
]
CLASSES = [
    (r"aastex\d*", "aastex"), (r"siamart\d*|siamltex", "siamart"), (r"(?:arxiv-)?lipics[\w-]*", "lipics"), (r"interspeech\w*", "interspeech"), (r"imsart[\w-]*", "imsart"), (r"cas-(?:sc|dc)", "elsarticle"),
    (r"conm-p-l|amsproc", "amsproc"), (r"\w*(?:thesis|dissertation)\w*", "thesis"), (r"frontiers\w*", "frontiers"), (r"mdpi", "mdpi"), (r"copernicus\w*", "copernicus"), (r"elife\w*", "elife"), (r"plos\w*", "plos"),
    (r"tufte-\w+", "tufte"), (r"scr(?:artcl|book|reprt)", "koma"), (r"ctex\w+", "ctex"), (r"apa[67]", "apa"), (r"sn-jnl", "sn-jnl"), (r"svjour3?", "svjour3"),
]
IEEE, ACM = ("conference", "compsoc"), ("sigconf", "acmsmall", "manuscript")


def template(document_class: Column, options: Column, packages: Column) -> Column:
    """The template that packages tell, else the class, else the class itself; two classes are told apart by their options."""
    whole = lambda pattern: rf"(?i)^(?:{pattern})\z"
    base = F.element_at(F.split(document_class, "/"), -1)
    some = lambda pattern: F.exists(packages, lambda p: p.rlike(whole(pattern)))
    by_style = [F.when(some(pattern), name) for pattern, name in STYLES]
    by_class = [F.when(base.rlike(whole(pattern)), name) for pattern, name in CLASSES]
    ieee = F.coalesce(*[F.when(F.array_contains(options, o), o) for o in IEEE], F.lit("journal"))
    acm = F.coalesce(F.get(F.filter(options, lambda o: o.isin(*ACM)), 0), F.lit("other"))
    own = F.when(base == "IEEEtran", F.concat(F.lit("IEEEtran-"), ieee)).when(base == "acmart", F.concat(F.lit("acmart-"), acm)).otherwise(base)
    return F.coalesce(*by_style, *by_class, own)


_CLASS = "['article', 'IEEEtran', 'acmart', 'my/aastex63', 'PhDThesis2', 'scrbook', 'svjour', 'lipics-v2021', 'sn-jnl', 'x/cas-sc', 'report']"
_OPTION = "['conference', 'compsoc', 'manuscript', 'sigconf', '10pt', 'twocolumn']"
_PACKAGE = "['amsmath', 'graphicx', 'neurips_2023', 'ICLR2024_conference', 'acl', 'aaai24', 'cvprx', 'natbib', 'xcolor', 'jheppub', 'hyperref', 'url', 'spconf2']"


def _pick(array: str, at: str) -> str:
    return f"element_at({array}, CAST({at} AS INT))"


_DUCK_TEMPLATE = "coalesce(" + ", ".join(
    [f"CASE WHEN len(list_filter(packages, lambda p: regexp_full_match(p, '{p}', 'i'))) > 0 THEN '{n}' END" for p, n in STYLES] + [f"CASE WHEN regexp_full_match(base, '{p}', 'i') THEN '{n}' END" for p, n in CLASSES]
) + ", CASE base WHEN 'IEEEtran' THEN 'IEEEtran-' || CASE WHEN list_contains(options, 'conference') THEN 'conference' WHEN list_contains(options, 'compsoc') THEN 'compsoc' ELSE 'journal' END WHEN 'acmart' THEN 'acmart-' || coalesce(list_filter(options, lambda o: o IN ('sigconf', 'acmsmall', 'manuscript'))[1], 'other') ELSE base END)"


@query(f"""
WITH r AS (SELECT o_orderkey, ({_CLASS})[1 + o_orderkey % 11] AS c, [({_OPTION})[1 + o_custkey % 6], ({_OPTION})[1 + o_orderkey % 6]] AS options, [({_PACKAGE})[1 + o_custkey % 13], ({_PACKAGE})[1 + o_orderkey % 2]] AS packages FROM orders),
b AS (SELECT *, string_split(c, '/')[-1] AS base FROM r) SELECT o_orderkey, {_DUCK_TEMPLATE} AS template FROM b""")
def paper_templates(spark, d):
    """STR-27: the template of a paper, by packages, class and options, in order."""
    array = lambda x: "array(" + x[1:-1] + ")"
    rows = load(spark, d, "orders").selectExpr(
        "o_orderkey", f"{_pick(array(_CLASS), '1 + o_orderkey % 11')} AS c", f"array({_pick(array(_OPTION), '1 + o_custkey % 6')}, {_pick(array(_OPTION), '1 + o_orderkey % 6')}) AS options",
        f"array({_pick(array(_PACKAGE), '1 + o_custkey % 13')}, {_pick(array(_PACKAGE), '1 + o_orderkey % 2')}) AS packages",
    )
    return rows.select("o_orderkey", template(F.col("c"), F.col("options"), F.col("packages")).alias("template"))


# ---- causes ------------------------------------------------------------------------------------------
def elements_with_id(html: Column, tokens: Column, most: int = 6) -> Column:
    """array of '<tag id="token">' for the first elements of a page whose id is one of tokens, token by token; it is a report of at most `most`."""
    quoted = lambda t: F.concat(F.lit(r'<(\w+)[^>]*\bid="\Q'), t, F.lit(r'\E"'))
    each = F.transform(tokens, lambda t: F.transform(F.regexp_extract_all(html, quoted(t), F.lit(1)), lambda tag: F.concat(F.lit("<"), tag, F.lit(' id="'), t, F.lit('">'))))
    return F.slice(F.flatten(each), 1, most)


@query("""
WITH p AS (SELECT page_id, replace(replace(html, '<p>', '<p class="x" id="eq:1.2">'), '<h1>', '<h1 id="sec:a">') AS h FROM pages)
SELECT page_id, list_concat(list_transform(regexp_extract_all(h, '<(\\w+)[^>]*\\bid="sec:a"', 1), lambda t: '<' || t || ' id="sec:a">'), list_transform(regexp_extract_all(h, '<(\\w+)[^>]*\\bid="eq:1\\.2"', 1), lambda t: '<' || t || ' id="eq:1.2">'))[1:6] AS found FROM p""")
def elements_by_id(spark, d):
    """DIF-08: elements of a page that a failure's tokens name."""
    html = F.replace(F.replace(F.col("html"), F.lit("<p>"), F.lit('<p class="x" id="eq:1.2">')), F.lit("<h1>"), F.lit('<h1 id="sec:a">'))
    return load(spark, d, "pages").select("page_id", elements_with_id(html, F.array(F.lit("sec:a"), F.lit("none"), F.lit("eq:1.2"))).alias("found"))


#: What an error says names something in the source: commands, and labels with a colon.
TOKENS = r"\\[A-Za-z@]{2,}|[\w.-]+:[\w:.-]+"


def cause(error: Column, raised_at: Column, failed_pass: Column, pass_error: Column) -> Column:
    """struct<stage, blame, equation, reason, error, tokens> of a failed attempt: a pass that failed is to blame, else the place that raised; of an equation the reason counts, as equations differ.

    tokens: the first three names in the first line of what is told.
    """
    math = r"(?s)^Neither equation renderer.*?rejected (.*): (Undefined control sequence (?:\\\S+)|[^:\n]+)\z"
    is_math = error.rlike(math)
    told = F.substring(F.coalesce(F.when(failed_pass.isNotNull(), pass_error), error, F.lit("")), 1, 800)
    reason = F.when(is_math, F.regexp_extract(error, math, 2))
    stage = F.when(is_math, "math").when(failed_pass.isNotNull(), "pass").otherwise(I.stage_of(raised_at))
    first = F.split_part(F.coalesce(reason, told), F.lit("\n"), F.lit(1))
    return F.struct(
        stage.alias("stage"), failed_pass.alias("blame"), F.when(is_math, F.substring(F.regexp_extract(error, math, 1), 1, 300)).alias("equation"), reason.alias("reason"), told.alias("error"),
        F.slice(F.regexp_extract_all(first, F.lit(TOKENS), F.lit(0)), 1, 3).alias("tokens"),
    )


@query(r"""
WITH e AS (SELECT event_id, event_id % 4 AS v, 'label eq:' || event_id || ' and \ref ' || event_type || chr(10) || 'more x:y' AS text FROM events)
SELECT event_id, CASE v WHEN 0 THEN 'math' WHEN 1 THEN 'pass' WHEN 2 THEN 'root' ELSE 'unknown' END AS stage, CASE WHEN v IN (0, 1) THEN 'prepare_x' END AS blame, CASE WHEN v = 0 THEN '\foo' || event_id END AS equation,
  CASE WHEN v = 0 THEN 'Undefined control sequence \foo' END AS reason, CASE v WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text ELSE '' END AS error,
  CASE v WHEN 0 THEN ['\foo'] WHEN 3 THEN []::VARCHAR[] ELSE ['eq:' || event_id, '\ref'] END AS tokens FROM e""")
def failure_causes(spark, d):
    """DIF-09: the cause of every failed attempt: stage, blame, equation and reason, names to look for in the source."""
    k = F.col("event_id")
    text = F.concat(F.lit("label eq:"), k.cast("string"), F.lit(" and \\ref "), F.col("event_type"), F.lit("\nmore x:y"))
    math = F.concat(F.lit("Neither equation renderer: MathJax rejected \\foo"), k.cast("string"), F.lit(": Undefined control sequence \\foo"))
    v = k % 4
    made = cause(F.when(v == 0, math).when(v == 3, F.lit(None)).otherwise(text), F.when(v == 2, "native/host.py:9 find_root_tex").otherwise("x"), F.when(v < 2, "prepare_x"), F.when(v < 2, text))
    return load(spark, d, "events").select("event_id", made.alias("c")).select("event_id", "c.*")


@query(r"""
WITH r AS (SELECT p_partkey, p_partkey % 5 AS v, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS n, p_brand AS b FROM part)
SELECT p_partkey, CASE v WHEN 0 THEN n || ' is 5% élan' WHEN 1 THEN n || ' of ' || b WHEN 2 THEN 'arXiv ' || p_partkey WHEN 3 THEN n ELSE n || ' x_1' END AS title,
  CASE v WHEN 0 THEN b || ', Second' WHEN 1 THEN 'Unknown authors' WHEN 2 THEN 'Unknown authors' WHEN 3 THEN b || ', Two' ELSE 'Łu ß' END AS authors FROM r""")
def tex_metadata(spark, d):
    """DOC-17, STR-04: titles and authors from sources: nested commands, notes, accents, aliases, comments."""
    k, n, b = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    v = k % 5
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    tex = (
        F.when(v == 0, join("% \\title{old}\n\\title[short]{\\textbf{", n, "\\thanks{to {all}}} \\emph{is 5\\% \\'elan}}\\author{", b, "\\footnote{x} \\and Second}"))
        .when(v == 1, join("\\newcommand{\\mytitle}{", n, " \\textit{of ", b, "}}\\title{\\mytitle}"))
        .when(v == 2, join("\\title{open ", n))
        .when(v == 3, join("\\icmltitle{", n, "}\\begin{icmlauthorlist}\\icmlauthor{", b, "}{a}\\icmlauthor{Two}{b}\\end{icmlauthorlist}"))
        .otherwise(join("\\title{", n, " $x\\_1$}\\author{\\L u~\\ss}"))
    )
    return spread(load(spark, d, "part"), "p_partkey").select("p_partkey", X.metadata(tex, k.cast("string")).alias("m")).select("p_partkey", "m.*")


# ---- sections of articles ------------------------------------------------------------------------------
def _edge(pattern: str) -> str:
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({pattern})($|[^\p{{L}}\p{{N}}_])".replace("'", "''")


_BODY = """concat({x}, CASE {k} % 4 WHEN 0 THEN ' It delves deep. You "leverage we".' WHEN 1 THEN ' We don’t ask, do we? Why?' WHEN 2 THEN ' “you” [we] `our` $you$ seamless' ELSE '' END)"""
_PROSE = P.NOT_PROSE.replace("'", "''")


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
s AS (SELECT doc_id, k, {_BODY.format(x='x', k='k')} AS body, string_split(x || CASE WHEN k % 3 = 0 THEN ' [p1]' ELSE '' END, '. ') AS points, CASE doc_id % 3 WHEN 0 THEN 'casual' WHEN 1 THEN 'semi-formal' ELSE 'formal' END AS tone FROM l),
p AS (SELECT *, regexp_replace(body, '{_PROSE}', ' ', 'g') AS plain FROM s),
t AS (SELECT doc_id, k AS owner, split_part(x, ' ', 1) AS term FROM l WHERE k IN (1, 2, 5) AND split_part(x, ' ', 1) <> ''),
q AS (SELECT doc_id, k, unnest(points) AS point, generate_subscripts(points, 1) - 1 AS i FROM s)
SELECT doc_id, k::INT AS pos, 'marker_words' AS rule, 'body' AS path FROM p WHERE regexp_matches(plain, '{_edge(P.MARKER_WORDS)}')
UNION ALL SELECT doc_id, k::INT, 'tone', 'body' FROM p WHERE (tone = 'semi-formal' AND regexp_matches(plain, '{_edge(P.YOU + "|" + P.CONTRACTION)}')) OR (tone = 'formal' AND regexp_matches(plain, '{_edge(P.YOU + "|" + P.WE + "|" + P.CONTRACTION)}'))
UNION ALL SELECT doc_id, k::INT, 'questions', 'body' FROM p WHERE len(regexp_extract_all(plain, '[?]')) > CASE tone WHEN 'casual' THEN 1 ELSE 0 END
UNION ALL SELECT doc_id, k::INT, 'citation', 'points[' || i || ']' FROM q WHERE NOT regexp_matches(point, '\[[^\]]+\]')
UNION ALL SELECT p.doc_id, p.k::INT, 'later_term', t.term FROM p JOIN t ON t.doc_id = p.doc_id AND p.k < t.owner WHERE regexp_matches(p.body, '(?i)(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(t.term) || '(e?s)?($|[^\p{{L}}\p{{N}}_])')""")
def section_faults(spark, d):
    """VAL-12: terms used before their section, register, marker words, questions, points without a citation; a section is a line of a document."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "x"))
    tone = F.when(F.col("doc_id") % 3 == 0, "casual").when(F.col("doc_id") % 3 == 1, "semi-formal").otherwise("formal")
    cited = F.concat("x", F.when(F.col("pos") % 3 == 0, " [p1]").otherwise(""))
    sections = lines.select("doc_id", "pos", F.expr(_BODY.format(x="x", k="pos")).alias("body"), F.split(cited, "[.] ").alias("points"), tone.alias("tone"))
    terms = lines.where(F.col("pos").isin(1, 2, 5)).select("doc_id", F.split_part("x", F.lit(" "), F.lit(1)).alias("term"), F.col("pos").alias("owner")).where("term <> ''")
    return P.section_faults(sections, terms, ["doc_id"], "pos", "body", "points", "tone")
