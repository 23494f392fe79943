"""Operators on small hand-made rows: edge cases that the tables don't hold."""

import random

import pytest
from pyspark.sql import functions as F

from quirestack.functions import text as T
from quirestack.operators import dml, matching, rules, windows
from quirestack.sources import files, html
from quirestack.streaming import jobs


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "make, value, want",
    [
        (T.squash, "  a\n b\t", "a b"),
        (T.squash, None, ""),
        (T.word_count, "", 0),
        (T.fingerprint, "A-b 3é", "ab3"),
        (T.base_id, "2305.08212v12", "2305.08212"),
        (T.version, "2305.08212v12", 12),
        (T.version, "x", 0),
        (T.tags, "#a-b #ü #a-b", ["#a-b", "#ü"]),
        (T.bracket_citations, "x [p00002, p00001] y [p00002] p00009", ["p00002", "p00001"]),
        (T.loose_citations, "x [p00002] p00009", 1),
        (T.uncited, "so it is [p00001, p00002].", "so it is."),
        (T.short_title, "Attention: all you need", "Attention"),
        (T.short_title, "A: b", "A: b"),
        (T.slug, " Hello, World! ", "hello-world"),
        (T.signature, 'no fig:x1 "q" in a/b.tex line 42\nmore', "no LABEL FILE in FILE line N"),
        (T.tex_escaped, "a_b $x_y$ 5%", "a\\_b $x_y$ 5\\%"),
        (T.prose, "Hi \\textbf{bold} \\cite{a} % gone\nend", "Hi bold end"),
        (T.reference_title, 'A. B. "On the words of texts," J. 2001', "On the words of texts"),
        (T.reference_title, "Doe, J. (2001). On the words of texts. Press.", "On the words of texts"),
        (T.heading_level, "3.1.2 Method", 3),
        (T.heading_level, "Method", 0),
        (T.anchor_key, "a:b", "ref-a:b"),
        (T.anchor_key, "a b", "refx-612062"),
        (T.normal_url, "https://www.Git.example/Own/Repo.git", "git.example/Own/Repo"),
        (T.lead, "abc", "Abc"),
        (T.first_sentence, "This is a sentence of some length. More.", "This is a sentence of some length."),
        (T.redacted, "to a.b@c.example and Bearer abc.def", "to ***@*** and Bearer ***"),
    ],
)
def test_text(spark, make, value, want):
    assert one(spark, value, make) == want


def test_all_words_and_search_expression(spark):
    assert one(spark, "Red Widget Brand#1", lambda c: T.all_words_in(c, " red  BRAND ")) is True
    assert one(spark, "the red fox", lambda c: T.search_expression(c, ["the"])) == "all:red AND all:fox"


def test_squash_is_idempotent(spark):
    for v in ("", " a ", "a b", "x\n\n y%_'\\"):
        once = one(spark, v, T.squash)
        assert one(spark, once, T.squash) == once


def test_windows(spark):
    rows = spark.createDataFrame([("a", i, lv, c) for i, (lv, c) in enumerate([(1, 5.0), (2, 9.0), (3, 2.0), (2, 3.0), (1, 1.0)])], "g string, o int, level int, cost double")
    parents = {r["o"]: r["parent"] for r in windows.heading_parent(rows, ["g"], "o", "level", "parent").collect()}
    assert parents == {0: None, 1: 0, 2: 1, 3: 0, 4: None}
    assert sorted(r["o"] for r in windows.skip_fill(rows, ["g"], "o", "cost", 8.0).collect()) == [0, 2, 4]
    assert sorted(r["o"] for r in windows.budget_prefix(rows, ["g"], ["o"], F.col("cost"), F.lit(8.0)).collect()) == [0]
    got = windows.switched(rows, ["g"], ["o"], F.col("level") == 3, F.col("level") == 1, "on").orderBy("o").collect()
    assert [r["on"] for r in got] == [False, False, True, True, False]
    first = windows.page(rows, ["o"], 0, 2).collect()
    assert {(r["total"], r["partial"], r["next_offset"]) for r in first} == {(5, True, 2)}
    assert windows.page(rows.limit(0), ["o"], 0, 2).collect() == []
    spans = spark.createDataFrame([("a", 0, 5), ("a", 4, 6), ("a", 6, 7)], "g string, s int, e int")
    assert [r["x"] for r in windows.overlaps(spans, ["g"], "s", "e", "x").orderBy("s").collect()] == [True, False, False]


def test_dml(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    assert {(r["k"], r["v"]) for r in dml.upsert(old, new, ["k"], "seq").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {(r["k"], r["v"]) for r in dml.insert_or_ignore(old, new.where("k = 3"), ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "e")}
    gone, kept = dml.deleted_and_kept(old, new.select("k"), ["k"])
    assert [r["k"] for r in gone.collect()] == [2] and [r["k"] for r in kept.collect()] == [1]
    assert dml.all_or_nothing(old, F.col("k") > 1).count() == 0 and dml.all_or_nothing(old, F.col("k") > 0).count() == 2
    before = spark.createDataFrame([("n", ["x"])], "id string, turns array<string>")
    now = spark.createDataFrame([("n", ["y"]), ("m", ["z"])], "id string, turns array<string>")
    assert {r["id"]: r["turns"] for r in dml.restored(before, now, "id", "turns").collect()} == {"n": ["x", "y"], "m": ["z"]}


def test_rules_fire_on_corrupted_rows(spark):
    rows = spark.createDataFrame([(1, 5.0, "red"), (2, float("nan"), "red"), (3, 1.0, None)], "id int, n double, colour string")
    made = [rules.Rule("finite", "n", rules.finite(F.col("n"))), rules.Rule("colour", "colour", F.col("colour").isin("red"))]
    assert {(r["id"], r["rule"]) for r in rules.issues(rows, ["id"], made).collect()} == {(2, "finite"), (3, "colour")}


def test_matching(spark):
    words = "alpha beta gamma delta epsilon zeta theta iota kappa lambda sigma omega"
    q = spark.createDataFrame([(1, words), (2, words.replace("zeta", "zetta")), (3, "nothing here is alike at all"), (4, "")], "q int, text string")
    p = spark.createDataFrame([(10, f"before {words} after"), (11, "other words entirely"), (12, None)], "p int, text string")
    got = {r["q"]: (r["found"], r["p"]) for r in matching.relocate(q, p, "q", "p").collect()}
    assert got == {1: ("found", 10), 2: ("moved", 10), 3: ("not-found", None), 4: ("not-found", None)}
    frozen = spark.createDataFrame([(1, "of Ice-Land and"), (2, "ICELAND, and WINTER nights"), (3, "ab"), (4, "the sea was quite calm that mornin"), (5, "你好世界"), (6, "zz zz")], "q int, text string")
    texts = spark.createDataFrame([(1, "tales of Ice-Land and ab"), (2, "tales of iceland and winter-nights, old"), (3, "so the sea was qiute calm that morning, they said, and far away the hills stood"), (4, "say 你好世界 now")], "p int, text string")
    got = {r["q"]: (r["found"], r["p"], r["words"]) for r in matching.relocate(frozen, texts, "q", "p").collect()}
    assert got == {
        1: ("found", 1, "of Ice-Land and"), 2: ("moved", 2, "iceland and winter-nights,"), 3: ("found", 1, "ab"), 4: ("moved", 3, "the sea was qiute calm that morning,"), 5: ("found", 4, "你好世界"), 6: ("not-found", None, None),
    }
    many = spark.createDataFrame([(i, "the same line of words stands here") for i in range(30)], "p int, text string").withColumn("section", F.when(F.col("p") == 21, "own").otherwise("other"))
    own = spark.createDataFrame([(1, "same line of words", "own"), (2, "same line of words", None)], "q int, text string, section string")
    assert {r["q"]: r["p"] for r in matching.relocate(own, many, "q", "p").collect()} == {1: 21, 2: 0}
    ten = spark.createDataFrame([(1, " ".join(["word"] * 10)), (2, " ".join(["word"] * 11))], "k int, text string")
    assert [(r["k"], r["spot"]) for r in matching.anchors(ten, "k", "text").collect()] == [(2, 0)]
    two = spark.createDataFrame([("xx quote yy quote zz", "quote", "yy ", " zz")], "t string, q string, b string, a string")
    assert two.select(matching.context_agreement(F.col("t"), F.col("q"), F.col("b"), F.col("a")).alias("n")).first()["n"] == 6


def test_html(spark):
    page = '<nav><li>Home</nav><article><h1>Title</h1><p>One <b>two</b><p>three<script>var p="<p>"</script></article>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    got = [(r["tag"], r["text"], r["area"], r["section"]) for r in html.blocks(pages, "id").orderBy("pos").collect()]
    assert got == [("li", "Home", "nav", None), ("h1", "Title", "article", "Title"), ("p", "One two", "article", "Title"), ("p", "three", "article", "Title")]
    m = spark.createDataFrame([(1, '<meta name="a" content="x"><meta name="a" content="y">')], "id int, html string")
    assert html.meta(m, "id").first()["values"] == ["x", "y"]


def test_jobs(spark):
    log = spark.createDataFrame([("a", "queued", 1, 1.0), ("a", "ready", 2, 2.0), ("a", "failed", 3, 3.0), ("b", "running", 4, 4.0)], "job string, state string, seq int, at double")
    got = {r["job"]: (r["state"], r["finished_at"]) for r in jobs.job_states(log).collect()}
    assert got == {"a": ("ready", 2.0), "b": ("running", None)}
    assert {r["state"] for r in jobs.recovered(jobs.job_states(log)).collect()} == {"ready", "interrupted"}
    before = spark.createDataFrame([("a", "running")], "job string, state string")
    assert [r["job"] for r in jobs.newly_finished(before, jobs.job_states(log), "job", "state").collect()] == ["a"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = jobs.read_log(spark, str(tmp_path / "in"), events.schema, "parquet")
    got = jobs.drain(jobs.counts(stream, "event_type", "ts"), "counted", str(tmp_path / "cp"))
    flat = lambda df: sorted((r["w"]["start"], r["event_type"], r["n"]) for r in df.collect())
    assert flat(got) == flat(jobs.counts(events, "event_type", "ts"))


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1)], "kind string, n int")
    files.append_jsonl(rows, str(tmp_path / "log"))
    files.append_jsonl(rows, str(tmp_path / "log"))
    assert files.read_jsonl(spark, str(tmp_path / "log"), "kind string, n int").count() == 2
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.tex").write_bytes("é".encode("latin-1"))
    (tmp_path / "src" / "b.tex").write_bytes("é".encode())
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["utf8"]) for r in files.read_sources(spark, str(tmp_path / "src")).collect()}
    assert got == {"a.tex": ("é", False), "b.tex": ("é", True)}
    names = spark.createDataFrame([(f"b{i}",) for i in range(9)], "name string")
    assert sorted(r["name"] for r in files.stale_snapshots(names).collect()) == ["b0", "b1"]
    (tmp_path / "feed.xml").write_text("<feed><entry><id>http://x/abs/1v2</id><title> A\n b</title><summary>s</summary><author><name>N</name></author></entry></feed>")
    feed = files.read_feed(spark, str(tmp_path / "feed.xml")).first()
    assert (feed["id"], feed["title"], feed["authors"]) == ("1v2", "A b", ["N"])
    tex = spark.createDataFrame([("d", "a/b.tex", "\\documentclass{x}"), ("d", "main.tex", "\\documentclass{x}\\input{b}"), ("d", "c.tex", "no")], "doc string, path string, text string")
    assert files.root_documents(tex).first()[:3] == ("d", "main.tex", False)


def test_diff_and_blame(spark):
    from quirestack.operators import diff

    old = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, ["same"])], "k int, items array<string>")
    new = spark.createDataFrame([(1, ["a", "B", "c", "d"]), (3, ["same"]), (4, ["y", "z"])], "k int, items array<string>")
    got = sorted((r["k"], r["pos"], r["old"], r["new"]) for r in diff.snapshot_diff(old, new, ["k"], "items").collect())
    assert got == [(1, 1, "b", "B"), (1, 3, None, "d"), (2, 0, "x", None), (4, 0, None, "y\nz")]
    versions = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b"]), (1, 3, ["a", "b"])], "k int, v int, lines array<string>")
    assert {(r["line"], r["since"]) for r in diff.blame(versions, ["k"], "v", "lines").collect()} == {("a", 3), ("b", 1)}
    moved = spark.createDataFrame([(1, 1, ["x", "y", "z"]), (1, 2, ["x", "new", "y", "z"]), (1, 3, ["x", "new", "y", "z"]), (1, 4, ["x", "new", "y", "z", "x"])], "k int, v int, lines array<string>")
    assert [(r["line"], r["since"]) for r in diff.blame(moved, ["k"], "v", "lines").orderBy("pos").collect()] == [("x", 1), ("new", 2), ("y", 1), ("z", 1), ("x", 4)]
    words = spark.createDataFrame([("a b c d e f g", "a b c d X f g")], "a string, b string").select(diff.word_changes(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert words == "...b c d [e -> X] f g..."
    assert diff.presence(versions, ["k"], "v", F.array_contains("lines", "a")).first()[1:] == (2, 2)


def test_archives(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    from quirestack.sources import archives

    def tar(name):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
        return out.getvalue()

    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="cover" href="c.xhtml"/><item id="n" href="nav.xhtml" properties="nav"/><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="cover"/><itemref idref="n"/><itemref idref="b"/><itemref idref="a"/></spine></package>'
    (tmp_path / "good.tgz").write_bytes(tar("x/a.tex"))
    (tmp_path / "bad.tgz").write_bytes(tar("../a.tex"))
    (tmp_path / "plain.tex").write_bytes(b"text")
    with zipfile.ZipFile(tmp_path / "book.epub", "w") as z:
        z.writestr("OEBPS/book.opf", opf)
    rows = archives.read_archives(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1]: (r["member"], r["error"] is None) for r in rows.collect()}
    assert got == {"good.tgz": ("x/a.tex", True), "bad.tgz": (None, False), "plain.tex": ("", True), "book.epub": ("OEBPS/book.opf", True)}
    assert [r["member"] for r in archives.epub_spine(rows).orderBy("pos").collect()] == ["OEBPS/b.xhtml", "OEBPS/a.xhtml"]


def test_contained_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 2, 3, 9, 60]))) for _ in range(80)] + [None, "w1 w2 w3 W4"]
    wanted = sorted({" ".join(rng.choices(words, k=3)) for _ in range(60)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(w,) for w in wanted], "anchor string")
    got = {tuple(r) for r in matching.contained(asked, docs, "anchor", "doc_id", "text", size=3).select("anchor", "doc_id").collect()}
    assert got == {(w, i) for w in wanted for i, t in enumerate(texts) if f" {w} " in f" {(t or '').lower()} "}
    assert matching.contained(asked.limit(0), docs, "anchor", "doc_id", "text", size=3).count() == 0


def test_relocate_uses_what_is_known(spark):
    line = "the same words stand here and there"
    p = spark.createDataFrame([(i, line if i in (2, 9, 15) else f"passage number {i} of other things", f"#a{i}", f"p{i}", float(i), "one" if i < 12 else "two") for i in range(20)], "p int, text string, href string, id string, spot double, section string")
    q = spark.createDataFrame(
        [(1, "same words stand", None, None, 9.0, None), (2, "same words stand", None, None, 13.0, "one"), (3, "same words stand", "#a15", None, 2.0, "one"), (4, "same words stand", None, "p9", 1.0, None), (5, "same words stand", "#a4", None, 4.0, None)],
        "q int, text string, href string, hint string, near double, section string",
    )
    assert {r["q"]: r["p"] for r in matching.relocate(q, p, "q", "p").collect()} == {1: 9, 2: 9, 3: 15, 4: 9, 5: 2}
    # A hint is a candidate even if it shares no rare word; another script is compared by its own words.
    texts = spark.createDataFrame([(1, "быстрая лиса прыгает через ленивую собаку у реки", "#x"), (2, "совсем другие слова о погоде и море", "#y"), (3, "aaaa bbbb cccc dddd eeee ffff", "#z")], "p int, text string, href string")
    asked = spark.createDataFrame([(1, "быстрая лиса прыгала через ленивую собаку", None), (2, "aaba bbab ccac ddbd eeae ffbf", "#z"), (3, "aaaab bbbbc ccccd dddde eeeef fffff", "#z")], "q int, text string, href string")
    got = {r["q"]: (r["found"], r["p"]) for r in matching.relocate(asked, texts, "q", "p").collect()}
    assert got[1] == ("moved", 1) and got[3][0] == "moved" and got[3][1] == 3


def test_relocate_across_passages(spark):
    rows = [(k, d, s, t) for k, (d, s, t) in enumerate([("a", 0, "it began on a cold and windy morning"), ("a", 1, "nothing of note was said in between"), ("a", 2, "and it ended when the rain had stopped"), ("b", 0, "and it ended when the rain had stopped"), ("b", 1, "it began on a cold and windy morning")])]
    p = spark.createDataFrame(rows, "p int, doc string, spot int, text string")
    q = spark.createDataFrame([(1, "a cold and windy morning", "and it ended when", 0.0, "a"), (2, "a cold and windy mornin", "ended when the rain hed stopped", 0.0, "a"), (3, "and it ended when", "nothing of note", 0.0, "a"), (4, "not there at all", "and it ended", 0.0, "a"), (5, "and it ended when", "a cold and windy", 0.0, "b")], "q int, head string, tail string, near double, doc string")
    got = {r["q"]: (r["p"], r["end_p"], r["found"], r["match"]) for r in matching.relocate_across(q, p, "q", "p", "doc", "spot").collect()}
    assert got[1] == (0, 2, "found", None) and got[3] == got[4] == (None, None, "not-found", None)
    assert got[5] == (3, 4, "found", None)
    assert {r["q"]: r["p"] for r in matching.relocate_across(q.drop("doc").where("q = 1"), p.where("doc = 'a'"), "q", "p", "doc", "spot").collect()} == {1: 0}
    assert got[2][:3] == (0, 2, "moved") and got[2][3].endswith("ended when the rain had stopped")


def test_anchor_of_selections(spark):
    text = "Alpha beta, gamma delta.\nNext line of the text"
    cases = [(8, 14, ("beta, gamma", "Alpha ", " delta.\nNext line of the text")), (5, 6, ("", "Alpha", " beta, gamma delta.\nNext line of")), (0, 5, ("Alpha", "", " beta, gamma delta.\nNext line of")), (5, 10, ("beta,", "Alpha ", " gamma delta.\nNext line of the t")), (43, 47, ("text", "lta.\nNext line of the ", ""))]
    df = spark.createDataFrame([(text, a, b) for a, b, _ in cases], "t string, a int, b int")
    got = [tuple(r["x"][:3]) for r in df.select(matching.anchor_of(F.col("t"), F.col("a"), F.col("b")).alias("x")).collect()]
    for (a, b, want), have in zip(cases, got):
        assert have[0] == want[0] and have[1].endswith(want[1][-20:]) and have[2] == want[2], (a, b, have)


def test_first_places_run_over_lines(spark):
    docs = spark.createDataFrame([(2, "one two\nthree four\n\nfive six seven"), (1, "zero\none two three")], "d int, text string")
    asked = spark.createDataFrame([(1, "two three four five six seven eight"), (2, "One, two!"), (3, "seven"), (4, "six five"), (5, ""), (6, None)], "a int, text string")
    assert sorted(tuple(r) for r in matching.first_places(asked, docs, "a", "d", "text").collect()) == [(1, 2, 1), (2, 1, 2), (3, 2, 4)]
    assert matching.first_places(asked.where("a > 4"), docs, "a", "d", "text").count() == 0


def test_links_in_bibliographies_and_comments(spark):
    page = '<p>own <a href="a">x</a></p><ol class="csl-bib-body"><li><a href="b">x</a></ol><table><tr><td class="tablecell comments">see <a href="c">x</a></td></tr></table><i class="comments"><a href="d">x</a></i>'
    rows = html.links(spark.createDataFrame([(1, page)], "k int, html string"), "k").orderBy("pos").collect()
    assert [(r["href"], r["in_bibliography"], r["in_comments"]) for r in rows] == [("a", False, False), ("b", True, False), ("c", False, True), ("d", False, False)]


def test_terms_are_quoted_and_know_letters(spark):
    from quirestack.functions import inputs

    df = spark.createDataFrame([("aa — bb – cc then x", "C++"), ("we use C++ here", "c++"), ("élan vital", "lan"), ("two Élans", "élan"), ("a.b", "a\\E.b")], "x string, t string")
    assert [r["u"] for r in df.select(inputs.uses_term(F.col("x"), F.col("t")).alias("u")).collect()] == [False, True, False, True, False]
    assert df.limit(1).select(inputs.dashes(F.col("x")).alias("d")).first()["d"] == ["aa — bb – cc then x"] * 2


def test_fingerprints_that_no_quote_has_stay_in_tasks(spark):
    from pyspark.sql import functions as F

    from quirestack.operators import matching as M

    texts = ["", None, "short", "The quick brown fox jumps over the lazy dog", "Ünïcode ﬁne 😀 letters that go on and on", "x" * 40, "0123456789" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    wanted = df.where("k IN (3, 6)").select(F.explode(M.fingerprints(F.col("text"))).alias("h")).distinct()
    all_ = {r[0]: set(r[1] or []) for r in df.select("k", M.fingerprints(F.col("text"))).collect()}
    kept = {r[0]: set(r[1] or []) for r in df.select("k", M.fingerprints_among(F.col("text"), wanted)).collect()}
    assert all(kept[k] <= all_[k] for k in all_) and kept[3] == all_[3] and kept[6] == all_[6] and all_[3] and not (all_[0] | all_[1] | all_[2])
    assert sum(map(len, (kept[4], kept[5]))) <= 1 < len(all_[4])
    one = [M._fingerprints_of([M.form_of(t or "")])[0] for t in texts]
    assert [set(x) for x in one] == [all_[k] for k in range(len(texts))]
