"""Manifests, main texts and prefix tries against plain versions, planted pages, SQL and edge rows."""

import hashlib
import math
import random
import zlib

import oracle
import pytest
from pyspark.sql import functions as F

from quirestack.llm import merkle, prefix_trie, registry, site_style

SF = "/root/testdata/sf0.01"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_prefix_trie"])
def test_equals_sql(spark, name):
    assert oracle.compare(registry.queries()[name](spark, SF), oracle.duck(SF), SQL[name])


# ---- manifests -----------------------------------------------------------------------------
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests):
    """(root, proof of each leaf) of one tree, level by level."""
    proofs, places, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, j in enumerate(places):
            run = range(j - j % 3, min(j - j % 3 + 3, len(level)))
            proofs[i].append(("".join(level[k] for k in run if k < j), "".join(level[k] for k in run if k > j)))
            places[i] = j // 3
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], proofs


def plain_manifest(rows):
    order = lambda v: (v is not None, (v or "").encode() if isinstance(v, str) else v or 0)
    by = {}
    for r in rows:
        leaf = sha("".join(field(r[c]) for c in merkle.FIELDS))
        by.setdefault(r["source"], []).append((order(r["doc_id"]), leaf, r["doc_id"]))
    names = sorted(by, key=order)
    trees = {s: plain_tree([x[1] for x in sorted(by[s])]) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        out += [(doc, leaf, trees[s][0], root, tuple(p + top)) for (_, leaf, doc), p in zip(sorted(by[s]), trees[s][1])]
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, size string, tree int, digest string, _at int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("height", [2, 6])
def test_manifest_equals_plain_tree(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "FRONTIER", 20)
    rng = random.Random(5)
    sizes = {"a": 1, "b": 2, "c": 3, None: 4, "": 10, "é": 28, "z": 300, "y": 82}
    rows = [(rng.randrange(10**12), f"text {rng.random()}\n", "en", s, 5) for s, n in sizes.items() for _ in range(n)]
    rows += [(None, None, None, "z", None), (7, "same", "en", "z", 4), (7, "same", "en", "z", 4), (7, "", "en", "z", 0), (8, "w " * 50_000, "en", "y", 1)]
    got = merkle.manifest(docs_of(spark, rows)).collect()
    plain = plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["proof"])) for r in got), key=repr) == plain
    assert all(r["other_leaf"] == r["leaf"] for r in got)


def test_manifest_finds_changes_and_edges(spark):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(30)]
    changed = merkle.manifest(docs_of(spark, rows), {"text": F.when(F.col("doc_id") == 11, "else").otherwise(F.col("text"))})
    folded = changed.select("doc_id", (merkle.fold(F.col("other_leaf"), F.col("proof")) == F.col("root")).alias("same")).collect()
    assert {r["doc_id"] for r in folded if not r["same"]} == {11}
    one = merkle.manifest(docs_of(spark, [(1, None, None, None, None)])).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof"] == []
    assert merkle.manifest(docs_of(spark, [])).count() == 0


# ---- prefix tries --------------------------------------------------------------------------
TURNS = "conv_id long, turn long, role string, text string, id int, digest string, top int, depth int, h int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1, 2, 3) for r in rows], TURNS)


def plain_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            key = hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest()
            own.setdefault(c, []).append(((t is not None, t or 0), key, (r or "", x or "")))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for p, m in members.items():
        sub = [q for q in members if q[: len(p)] == p]
        kids = [q for q in sub if len(q) == len(p) + 1]
        leaves = sum(not any(len(q) == len(n) + 1 and q[: len(n)] == n for q in members) for n in sub)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q)
        ends = sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), leaves, saved, ends))
    return sorted(out, key=repr)


@pytest.mark.parametrize("local", [(1024, 1 << 18), (4, 1 << 18), (1, 1)])
def test_trie_equals_plain_trie(spark, monkeypatch, local):
    monkeypatch.setattr(prefix_trie, "LOCAL_SEQUENCES", local[0])
    monkeypatch.setattr(prefix_trie, "LOCAL_TURNS", local[1])
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    rng = random.Random(local[0])
    rows = []
    for c in [*range(-3, 40), 100, 101, 102, 205, 2**62 + 1]:
        for t in range(rng.choice([1, 2, 2, 3, 6])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ü😀", None])))
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (8, 0, "user", "tie"), (None, 0, "user", "nobody"), (9, 5, "", "")]
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 330) for t in range(7)]
    rows += [(400, t, "user", f"long {t}") for t in range(60)] + [(401, t, "user", f"long {t}" if t < 50 else "other") for t in range(60)]
    got = [tuple(r) for r in prefix_trie.prefix_trie(turns_of(spark, rows)).select(*[f.split()[0] for f in prefix_trie.NODES.split(", ")][:-1]).collect()]
    assert sorted(got, key=repr) == plain_trie(rows)


def test_trie_edges(spark):
    assert prefix_trie.prefix_trie(turns_of(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(turns_of(spark, [(None, 1, "a", "b")])).count() == 0
    long = [(600, t, "user", "x" * 20_000) for t in range(30)]
    assert prefix_trie.prefix_trie(turns_of(spark, long)).count() == 31


# ---- main texts ----------------------------------------------------------------------------
def texts_of(spark, pages):
    rows = [(i, u, h, 1, "x", 2) for i, u, h in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key int, host string, blocks int")
    return {r["page_id"]: r["text"] for r in site_style.main_text(df).collect()}


def test_marked_articles_lose_everything_else(spark):
    head = "<!DOCTYPE html><html><head><title>T</title><style>p{a>b}</style><script>var x='</p><p>no';</script></head><body class='no-sidebar'>"
    noise = ["<nav><ul><li><a href='/'>Home</a></ul></nav>", "<header class=site-header><h2>Site</h2></header>", "<div class='ad'>Buy</div>", "<div id='cookie-notice'>Cookies</div>",
             "<aside>Side</aside>", "<div class=sidebar><p>More</div>", "<form><label>Mail</label><input><button>Go</button></form>", "<section id='comments'><article><p>I disagree</p></article></section>",
             "<footer>&copy; x</footer>", "<!-- ad --><noscript>on</noscript>", "<div style='display: none'>hid</div>", "<div role=navigation>Up</div>"]
    body = "<article class=post><h1>One &amp; two &lt;3</h1><div class=share-buttons>Share</div><p><b>First\n  <i>line</i><br>and&nbsp;more<p>Second &eacute; <span class=ad>AD</span>x<ul><li>a<li>b</ul>"
    body += "<form>Search<select><option>o</select></form><table><tr><td>1<td>2</table><pre>k  k</pre><div class='comments'><p>wow</p></div></article>"
    want = "One & two <3\n\nFirst line and more\n\nSecond é x\n\na\n\nb\n\n1 2\n\nk k"
    pages = [(k, f"https://h{k % 3}.org/{k}", head + "".join(noise[:k]) + body + "".join(noise[k:]) + ("</body></html>" if k % 2 else "")) for k in range(len(noise) + 1)]
    got = texts_of(spark, pages)
    assert got == dict.fromkeys(range(len(pages)), want)  # however often a site shows the article


def test_sites_without_marks_lose_what_repeats(spark):
    page = "<div class=top>Welcome to our site</div><div class=box{0}><h1>Title {1}</h1><p>Text of {1}</p><p>Shared line</p></div><div class=bot>All rights reserved<p>{1} visitors</p></div>"
    pages = [(i, f"http://Site.org:80/{i}", page.format(i % 2, f"no {i}")) for i in range(12)]
    pages += [(100 + i, f"http://few.org/{i}", "<p>Same on both pages") for i in range(2)]
    pages += [(200 + i, "http://copies.org/", "<div class=a><p>One page, many copies</div>") for i in range(20)]
    got = texts_of(spark, pages)
    for i in range(12):
        assert got[i].startswith(f"Title no {i}\n\nText of no {i}\n\nShared line") and "Welcome" not in got[i]
    assert got[100] == "Same on both pages" and got[219] == "One page, many copies"


def test_main_text_edges(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    odd = [(1, None, None), (2, "", ""), (3, "x", "plain & simple"), (4, "http://a/", "<p>open <b>bold"), (5, "http://a/", "<script>only"), (6, "http://a/", deep), (6, "http://a/", deep),
           (None, "http://a/", "<!-- never closed <p>x"), (8, "http://a/", "a < b <![CDATA[c]]> d"), (9, "http://a/", "<p title='a>b'>quoted</p><p id=\"open>y</p>"), (10, "http://a/", "<main></main><p>outside"),
           (11, "http://a/", "<p>" + "word " * 200_000), (12, "http://a/", "<article"), (13, "http://a/", "<div class=sidebar>all of it</div>")]
    got = texts_of(spark, odd)
    assert [got[k] for k in (1, 2, 3, 4, 5, 6, None, 8, 10, 12, 13)] == ["", "", "plain & simple", "open bold", "", "deep", "", "a < b d", "outside", "", "all of it"]
    assert got[9].startswith("quoted") and len(got[11]) == 5 * 200_000 - 1
    assert texts_of(spark, []) == {}


def plain_importance(pages):
    """Composite importance of the nodes of one site by recursion over what pages add to the tree."""
    seen, looks, said, paths = set(), {}, {}, {}
    for blocks, nodes in pages:
        says = tuple(b[2] for b in blocks)
        if says in seen:
            continue
        seen.add(says)
        for path, style, share, text_share, kids in nodes:
            looks.setdefault(path[-1], []).append((style, share, text_share, kids))
            paths[path[-1]] = path
        for node, text in {(b[0], b[2]) for b in blocks}:
            said.setdefault(node, {}).setdefault(text, []).append(1)

    def entropy(counts, m):
        return sum(c / m * math.log(m / c) for c in counts) / math.log(m)

    def composite(node):
        rows = looks[node]
        m, styles = len(rows), {}
        for r in rows:
            styles[r[0]] = styles.get(r[0], 0) + 1
        texts = [len(v) for v in said.get(node, {}).values()]
        content = None if not texts else 1.0 if m == 1 else sum(1 - math.log(n) / math.log(m) for n in texts) / len(texts)
        if not max(r[3] for r in rows):
            return content
        fade, look = 0.9 ** len(styles), 1.0 if m == 1 else entropy(styles.values(), m)
        parts = sum(r[2] for r in rows) / m * (content or 0)
        for kid, path in paths.items():
            if len(path) > 1 and path[-2] == node:
                parts += sum(r[1] for r in looks[kid]) / m * composite(kid)
        return (1 - fade) * look + fade * parts

    return {n: composite(n) for n in looks}


def test_importance_equals_recursion(spark):
    rng = random.Random(2)
    htmls = []
    for i in range(25):
        parts = [f"<div class=c{k}>{rng.choice(['same', 'same', str(i)])}<p>{rng.choice(['x', 'y', str(i)])}</p>" + "<ul><li>l</ul>" * rng.randrange(2) + "</div>" for k in range(rng.randint(1, 4))]
        htmls.append("<body>" + "".join(parts))
    htmls += htmls[:3]
    rows = spark.createDataFrame([(i, "h", x) for i, x in enumerate(htmls)], "key long, host string, html string")
    got = {r["node"]: r["composite"] for r in site_style.importance(site_style.parsed(rows)).collect()}
    want = plain_importance([site_style.read_page(x) for x in htmls])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_every_page_of_the_table(spark):
    rows = site_style.op12_site_style(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r["text"] and r["n_chars"] == len(r["text"]) for r in rows)
