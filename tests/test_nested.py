"""Rules over nested arrays, nested documents, nested values and packages, by hand."""

import json

from pyspark.sql import functions as F

from quirestack.operators import nested as N
from quirestack.operators import packages, variants
from quirestack.sources import markup


def found(spark, records, rules, known=None):
    df = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)], "k int, j string")
    return sorted((r["k"], r["rule"], r["path"]) for r in N.issues(df, ["k"], F.try_parse_json("j"), rules, "r", known).collect())


def test_rules_at_any_depth(spark):
    rules = [
        N.Rule("list", "", N.count("a", 1, 2), "a"), N.Rule("object", "a[*]", N.is_kind("", "OBJECT")), N.Rule("name", "a[*].b[*]", N.text("n", 3), "n"), N.Rule("deep", "a[*].b[*].c[*]", N.text("", 2)),
        N.Rule("first", "a[*]", N.Test(lambda e: e.place == 0, "place = 0"), "", N.has("b")), N.Rule("refs", "o", N.references("p"), "p"), N.Rule("once", "o", N.distinct("p"), "p"),
    ]
    records = [
        {"a": [{"b": [{"n": "ok", "c": ["x", "", 5, "long"]}, {"n": "long"}, 7]}], "o": {"p": ["p1", "p1"]}}, {"a": [1, {"b": []}, {}], "o": {"p": []}}, {"a": {"b": 1}}, [1], "no json", None, {"a": [{}], "o": {"p": ["p9", 3]}},
    ]
    got = found(spark, records, rules, F.array(F.lit("p1")))
    assert got == sorted([
        (0, "deep", "r.a[0].b[0].c[1]"), (0, "deep", "r.a[0].b[0].c[2]"), (0, "deep", "r.a[0].b[0].c[3]"), (0, "name", "r.a[0].b[1].n"), (0, "name", "r.a[0].b[2].n"), (0, "once", "r.o.p"),
        (1, "list", "r.a"), (1, "object", "r.a[0]"), (1, "first", "r.a[1]"), (1, "refs", "r.o.p"), (2, "list", "r.a"), (3, "list", "r.a"), (4, "list", "r.a"), (5, "list", "r.a"), (6, "refs", "r.o.p"),
    ])


def page(spark, *htmls):
    return markup.elements(spark.createDataFrame(list(enumerate(htmls)), "k int, html string"), "k")


def test_elements_are_intervals(spark):
    rows = page(spark, "<div>a<p>b<p>c<ul><li>d<li>e</ul></div>f<br>", None, "", "<p>x <math alttext='a  + b'><mi>a</mi></math>y <math><mi>z</mi></math>")
    got = [(r["k"], r["pre"], r["end"], r["parent"], r["tag"], r["text"]) for r in rows.orderBy("k", "pre").collect()]
    assert got[:7] == [(0, 0, 5, None, "div", "abcde"), (0, 1, 1, 0, "p", "b"), (0, 2, 2, 0, "p", "c"), (0, 3, 5, 0, "ul", "de"), (0, 4, 4, 3, "li", "d"), (0, 5, 5, 3, "li", "e"), (0, 6, 6, None, "br", "")]
    assert got[7] == (3, 0, 4, None, "p", "x $a + b$ y z")
    assert [r["pre"] for r in markup.outermost(rows.where("k = 0 AND tag IN ('p', 'ul', 'li')"), "k").orderBy("pre").collect()] == [1, 2, 3]


def test_ids_resolve(spark):
    html = '<div id="a"><p id="a">x</p></div><p id="b">1</p><p id="b">2</p><p id="b">3</p><p id="c c">s</p><span id="d" data-label="d"></span><h1 id="d">t</h1><i id="e"></i><i id="e"></i><i id="e-duplicate-1"></i>'
    rows = markup.resolved_ids(page(spark, html), "k").where("id IS NOT NULL").orderBy("pre").collect()
    new = [r["new_id"] for r in rows]
    assert new[:5] == ["a", None, "b-duplicate-1", "b-duplicate-2", "b"] and new[5].startswith("anchor-") and new[6:] == [None, "d", "e-duplicate-1", "e", "e-duplicate-1"]
    assert [r["conflict"] for r in rows] == [False] * 8 + [True, False, False]


def test_sections_and_abstracts(spark):
    html = '<article><div class="abstract"><p>Short</p><p class="author">Me</p><p>Author note: x</p></div><section><h2>One</h2><p>a</p><section><section><h3>Deep</h3><p>bb</p></section></section></section></article>'
    rows = page(spark, html, "<p>loose</p>")
    got = [tuple(r)[1:] for r in markup.sections(rows, "k", ["p", "h2", "h3"]).orderBy("section").collect()]
    pres = {r["text"]: r["pre"] for r in rows.where("k = 0").collect()}
    one, deep = pres["One"] - 1, pres["Deep"] - 1
    assert got == [(0, None, None, 3, 5 + 2 + 14), (one, 0, "One", 2, 4), (deep, one, "Deep", 2, 6)]
    assert [tuple(r) for r in markup.abstracts(rows, "k", ["p"]).orderBy("k").collect()] == [(0, "identified", ["Short"]), (1, "unavailable", [])]


def test_nested_sections_are_not_paired_with_those_around(spark):
    """300 sections inside each other give as many rows as elements, not one for each pair; two parents by hand."""
    rows = page(spark, "<section><p>a</p>" * 300 + "</section>" * 300, "<section><p>a</p><div><section></section><section><p>b</p></section></div></section>")
    marked = rows.withColumn("s", F.col("tag") == "section")
    near = markup.inside(marked, "k", F.lit(True), F.col("s"), ["pre"]).where("k = 0")
    assert near.where("in_pre <> pre AND s OR in_pre <> pre - 1 AND NOT s OR in_pre IS NULL").isEmpty() and near.count() == 600
    got = {tuple(r)[:3] for r in markup.sections(rows, "k", ["p"]).collect()}
    assert got == {(0, 2 * i, 2 * i - 2 if i else None) for i in range(300)} | {(1, 0, None), (1, 4, 0)}
    assert "Join" not in markup.sections(rows, "k", ["p"])._jdf.queryExecution().optimizedPlan().toString()
    assert {r["text"] for r in markup.elements(spark.createDataFrame([(1, "<p>a<b>c</b></p>")], "k int, html string"), "k", texts={"b"}).collect()} == {None, "c"}


def test_safe_markup():
    cases = {
        '<p onclick="x()">a<script>alert(1)</script>b</p>': "<p>ab</p>", "<a href='JaVa\nScript:x'>t</a>": "<span>t</span>", '<a href="doi:10.1/x">t</a>': '<a href="https://doi.org/10.1/x">t</a>',
        '<a href="mailto:">me</a>': "<span>me</span>", '<a href="http://x/a\\_b">t</a>': '<a href="http://x/a_b">t</a>', '<img src="a.png" alt="1 &lt; 2">': '<img src="a.png" alt="1 &lt; 2">', '<img src="data:x">': "<img>",
        "<form><input><p>ask</p></form>after": "after", "<ul><li>a<li>b": "<ul><li>a</li><li>b</li></ul>", "1 < 2 & 3": "1 &lt; 2 &amp; 3", "<svg><a xlink:href='javascript:x'>q</a></svg>": "<svg><a>q</a></svg>",
    }
    for html, want in cases.items():
        got, _ = markup.safe(html)
        assert got == want, html
        assert markup.safe(got) == (got, []), html


def test_nested_values(spark):
    rows = [(1, '{"b":[1,{"c":[]}],"a":"x"}', '{"b":[1,{"c":[2]}],"a":"x"}'), (2, "[1,[2,3]]", "[1,[2,4]]"), (3, "[]", "[]"), (4, '{"a":1}', '{"a":"1"}'), (5, "no", "5"), (6, "[1]", "[1,2]")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    old, new = (df.select("k", F.try_parse_json(c).alias("v")) for c in "ab")
    assert sorted((r["path"], str(r["order"])) for r in variants.leaves(old.where("k = 1"), ["k"], "v").collect()) == [("$.a", "['a']"), ("$.b[0]", "['b', '0000000000']"), ("$.b[1].c", "['b', '0000000001', 'c']")]
    got = {r["k"]: (r["path"], r["old"], r["new"]) for r in variants.first_difference(old, new, ["k"], "v").collect()}
    assert got == {1: ("$.b[1].c", "[]", None), 2: ("$[1][1]", "3", "4"), 4: ("$.a", "1", '"1"'), 5: ("$", None, "5"), 6: ("$[1]", None, "2")}


def test_search_rows(spark):
    body = json.dumps({"data": [{"externalIds": {"ArXiv": "2401.00001v2"}, "title": " A  b ", "authors": [{"name": "X"}, {}, 3], "year": "y", "abstract": None}, {"externalIds": None}, 5, {"externalIds": {"ArXiv": "2401.00002"}, "title": 5}]})
    rows = spark.createDataFrame([(1, body), (2, "<html>"), (3, None), (4, "{}")], "k int, b string")
    got = [tuple(r)[1:] for r in variants.search_rows(rows, ["k"], "b").orderBy("k", "place").collect()]
    assert got == [(0, "2401.00001", "A b", ["X"], None, "", "data"), (1, "2401.00002", "", [], None, "", "data")]
    assert variants.search_rows(rows, ["k"], "b", limit=1).count() == 1


def test_package_links(spark):
    cases = [("text/a.xhtml", "b.xhtml", "text/b.xhtml"), ("text/a.xhtml", "../img/x%20y.png#f", "img/x y.png"), ("a.xhtml", "../../x", "../../x"), ("t/a.xhtml", "#part", "t/a.xhtml"), ("t/a.xhtml", "./c/../d", "t/d")]
    df = spark.createDataFrame([c[:2] for c in cases], "base string, link string")
    assert [r["x"] for r in df.select(packages.resolved(F.col("base"), F.col("link")).alias("x")).collect()] == [c[2] for c in cases]


def test_package_without_faults_and_empty_one(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    members = make([(1, 0, "mimetype", "stored", "application/epub+zip"), (1, 1, "a", "deflated", None), (1, 2, "c.png", "stored", None), (2, 0, "x", "stored", None), (2, 1, "x", "stored", None)], "k int, pos long, name string, method string, content string")
    manifest = make([(1, "i", "a", "application/xhtml+xml", None), (1, "c", "c.png", "image/png", "cover-image")], "k int, item string, name string, media string, properties string")
    spine, links = make([(1, 0, "i")], "k int, pos long, item string"), make([(1, "a", "#s"), (1, "a", "http://x")], "k int, name string, link string")
    ids, heads = make([(1, "a", "s")], "k int, name string, id string"), make([(1, 0, "Abstract"), (1, 1, "1 One"), (1, 2, "References")], "k int, at int, text string")
    got = sorted((r["k"], r["rule"]) for r in packages.faults(members, manifest, spine, links, ids, packages.numbered(heads, "k", ["at"]), "k").collect())
    assert got == [(2, "abstract_missing"), (2, "covers"), (2, "member_twice"), (2, "mimetype"), (2, "reading_order_empty"), (2, "references_missing")]


def test_package_tables_meet_without_joins(spark):
    """Items and members given twice, items that are nowhere, links and ids of what isn't there; no table is sent to the driver to be joined."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    members = make([(1, 0, "mimetype", "stored", "application/epub+zip"), (1, 1, "a", "x", None), (1, 2, "a", "x", None), (1, 3, "b", "x", None)], "k int, pos long, name string, method string, content string")
    manifest = make([(1, "i", "a", "t", None), (1, "i", "gone", "t", "x cover-image"), (1, "j", None, "t", None), (9, "c", "c", "image/png", "cover-image")], "k int, item string, name string, media string, properties string")
    spine = make([(1, 0, "i"), (1, 1, "i"), (1, 2, "z"), (1, 3, "z"), (1, 4, None), (1, 5, "j")], "k int, pos long, item string")
    links = make([(1, "a", "b#p"), (1, "b", "b#p"), (1, "b", "a#p"), (1, "b", "gone#p"), (1, "b", "#q")], "k int, name string, link string")
    ids = make([(1, "b", "p"), (1, "gone", "p"), (1, "b", "p")], "k int, name string, id string")
    heads = make([(1, 0, "1 One"), (1, 1, "Abstract"), (9, 1, "Abstract")], "k int, at int, text string")
    rows = packages.faults(members, manifest, spine, links, ids, packages.numbered(heads, "k", ["at"]), "k")
    got = sorted(((r["rule"], r["what"]) for r in rows.collect()), key=str)
    want = [("abstract_late", "1"), ("cover_kind", "t"), ("cover_missing", "c"), ("cover_missing", "gone"), ("link_fragment", "#q"), ("link_fragment", "a#p"), ("link_missing", "gone#p"), ("member_twice", "a")]
    want += [("reading_order_item", x) for x in ("z", "z", None)] + [("reading_order_missing", x) for x in ("gone", "gone", None)] + [("references_missing", "")]
    assert got == sorted(want, key=str)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_digests_normalise(spark):
    from quirestack.plans import causes

    records = [{"example": {"text": "t"}, "components": [{"id": "a", "contains": ["a", "b", 5], "feeds": "a"}, 7]}, {"example": {"words": 1}, "components": "x"}, [1], {"example": "e", "components": [{"feeds": [None, "x"]}]}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "k int, j string")
    got = [json.loads(r["x"]) for r in df.select("k", F.to_json(causes.normalized_digest(F.try_parse_json("j"))).alias("x")).orderBy("k").collect()]
    assert got == [{"example": "t", "components": [{"id": "a", "contains": ["b", 5], "feeds": "a"}, 7]}, records[1], [1], records[3]]


def test_templates(spark):
    from quirestack.plans import causes

    rows = [("article", [], ["amsmath", "NeurIPS_2024"], "neurips"), ("x/IEEEtran", ["10pt"], [], "IEEEtran-journal"), ("IEEEtran", ["compsoc", "conference"], [], "IEEEtran-conference"), ("acmart", ["x", "manuscript", "sigconf"], [], "acmart-manuscript"), ("MyThesis", [], ["neurips_2024x"], "thesis"), ("plain", [], [], "plain")]
    df = spark.createDataFrame(rows, "c string, o array<string>, p array<string>, want string")
    assert all(r["got"] == r["want"] for r in df.select(causes.template(F.col("c"), F.col("o"), F.col("p")).alias("got"), "want").collect())


def test_sections_of_articles(spark):
    from quirestack.operators import prose

    rows = [
        (1, 0, "Plain words. They work.", ["a [p1]", "b"], "formal"), (1, 1, 'We say "you can\'t".', ["c [p2]"], "formal"), (1, 2, "It's C++ here?", [], "semi-formal"), (1, 3, "Why? You, we and it's fine.", ["[x]"], "casual"),
        (2, 0, "Über Seamlessness and owe, yours", None, "casual"), (2, 1, "They delve?? into", ["[]"], "casual"),
    ]
    sections = spark.createDataFrame(rows, "k int, pos int, body string, points array<string>, tone string")
    terms = spark.createDataFrame([(1, "word", 1), (1, "C++", 3), (1, "they", 0), (2, "über", 1)], "k int, term string, owner int")
    got = sorted(tuple(r) for r in prose.section_faults(sections, terms, ["k"], "pos", "body", "points", "tone").collect())
    assert got == sorted([
        (1, 0, "citation", "points[1]"), (1, 0, "later_term", "word"), (1, 1, "tone", "body"), (1, 2, "tone", "body"), (1, 2, "questions", "body"), (1, 2, "later_term", "C++"), (2, 0, "later_term", "über"),
        (2, 1, "marker_words", "body"), (2, 1, "questions", "body"), (2, 1, "citation", "points[0]"),
    ])


def test_neighbours_within_room(spark):
    from quirestack.plans import outline

    def plain(sizes, start, room):
        low = high = start
        room -= sizes[start]
        going = True
        while going:
            going = False
            if low > 0 and sizes[low - 1] <= room:
                low, room, going = low - 1, room - sizes[low - 1], True
            if high + 1 < len(sizes) and sizes[high + 1] <= room:
                high, room, going = high + 1, room - sizes[high + 1], True
        return low, high

    import random

    rng = random.Random(6)
    cases = [(i, [rng.randrange(1, 40) for _ in range(n)], n // 2) for i, n in enumerate(rng.randrange(1, 30) for _ in range(200))]
    df = spark.createDataFrame(cases, "i int, n array<int>, s int")
    got = {r["i"]: tuple(r["r"]) for r in df.select("i", outline.expanded(F.col("n"), F.col("s"), 120).alias("r")).collect()}
    assert got == {i: plain(n, s, 120) for i, n, s in cases}


def test_what_elements_ask_is_worked_out_once(spark):
    """1,500 components that each look at all ids of their record; what ten rules ask of an element is in the plan once."""
    from quirestack.plans.nested import DIGEST

    ids = [f"c{i % 1000}" for i in range(1500)]
    parts = [{"id": x, "feeds": [ids[i - 1], "no"] if i == 7 else [ids[i - 1]], "contains": [x] if i == 9 else []} for i, x in enumerate(ids)]
    rules = [r for r in DIGEST if r.name in ("component_id_once", "feeds_known", "contains_known", "contains_itself", "feeds_itself")]
    df = spark.createDataFrame([(1, json.dumps({"components": [*parts, {"name": 5}, {"id": None}, 7]}))], "k int, j string")
    rows = N.issues(df, ["k"], F.try_parse_json("j"), rules, "r")
    got = sorted((r["rule"], r["path"]) for r in rows.collect())
    assert got == sorted([("component_id_once", f"r.components[{i}].id") for i in range(1000, 1500)] + [("feeds_known", "r.components[7].feeds"), ("contains_itself", "r.components[9].contains")])
    asked = []
    ask = N.Test(lambda a: N.once(a.root, ("odd",), lambda c: asked.append(1) or N.kind(c, "a") == "ARRAY"), "true")
    one = N.issues(df, ["k"], F.try_parse_json("j"), [N.Rule(f"r{i}", "components[*]", ask) for i in range(10)], "r")
    assert one.count() == 10 * 1503 and len(asked) <= 11  # noted by each rule, built once
    kinds = N.issues(df, ["k"], F.try_parse_json("j"), [N.Rule(f"r{i}", "components[*]", N.is_kind("id", "STRING")) for i in range(10)], "r")
    assert kinds._jdf.queryExecution().optimizedPlan().toString().count("schemaOfVariant(") == 1


def test_prose_of_a_section_is_made_once(spark):
    """Quotes and mathematics leave a section's text once, not for each rule."""
    from quirestack.operators import prose

    sections = spark.createDataFrame([(1, 0, 'You delve "we delve" $you?$ ?', ["a [p1]"], "formal")], "k int, pos int, body string, points array<string>, tone string")
    terms = spark.createDataFrame([], "k int, term string, owner int")
    rows = prose.section_faults(sections, terms, ["k"], "pos", "body", "points", "tone")
    assert sorted(r["rule"] for r in rows.collect()) == ["marker_words", "questions", "tone"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(body") == 1
