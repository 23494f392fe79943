"""Operators on whole corpora against brute force, held-out accuracy and edge cases."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirestack.llm import common, embedding_dedup, jaccard_join, labelled, mixing, quality, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None), (2, ""), (3, "   "), (4, "one"), (4, "one"), (None, "null id"), (5, "word " * 60_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def brute_classes(rows, percent, width):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}
    for a, b in pairs:
        same = len(sets[a] & sets[b])
        if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent, width", [(85, 4), (80, 5), (50, 2)])
def test_jaccard_join_equals_brute_force(spark, percent, width):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], rng.choices(words, k=60)
    for base in range(12):
        text = rng.choices(words, k=rng.choice([1, 3, 4, 5, 9, 30, 120, 400]))
        if base % 3 == 0:
            text = text + passage  # a passage that many documents share
        for _ in range(8):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), rng.choice([" ", "\n"]).join(copy).replace("w1", rng.choice(["W1", "w1"]))))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "é É"), (904, "é É")]
    got = {tuple(r) for r in jaccard_join.join(frame(spark, rows), percent, width).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_classes(rows, percent, width)


def test_jaccard_join_edges(spark):
    rows = [*EDGE, (6, "shared by two keys of one"), (7, "shared by two keys of one"), (7, "quite another text of words"), (9, "quite another text of words")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.join(frame(spark, rows).withColumn("id", F.lit(0)).withColumn("band", F.lit(0)), 85, 4).collect())
    assert [g for g in got if g[0] in "679"] == [("6", 3, 6), ("7", 2, 6), ("7", 3, 6), ("9", 2, 6)] and len(got) == len(rows)
    assert ("None", 1, None) in got and ("5", 1, 5) in got and got.count(("4", 1, 4)) == 2 and ("1", 0, 1) in got
    assert jaccard_join.join(frame(spark, []), 85, 4).count() == 0


def test_sketch_bounds_difference():
    plan = jaccard_join.Plan(85)
    rng = np.random.default_rng(1)
    for n in (1, 5, 12, 100, 700):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: max(1, int(len(a) * 0.95))], rng.integers(0, 2**63, max(1, n // 50), dtype=np.uint64)])
        linked = 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        for (x, s), (y, t) in itertools.product(jaccard_join.fine_sketch(a, plan), jaccard_join.fine_sketch(b, plan)):
            if x == y:
                assert np.bitwise_count((s ^ t).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
        keys = [{(band, *k) for band, number, value, _ in jaccard_join.block_keys(h, plan) for k in zip(number.tolist(), value.tolist())} for h in (a, b)]
        assert not linked or keys[0] & keys[1]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows, threshold=0.9):
    """key -> number of linked vectors, over usable vectors of one length."""
    unit = {}
    for k, v in rows:
        v = np.array([np.nan if x is None else x for x in v or []], float)
        if len(v) and np.isfinite(v).all() and v.any():
            unit[k] = v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())
    return {k: sum(1 for j, w in unit.items() if j != k and len(w) == len(unit[k]) and unit[k] @ w >= threshold) if k in unit else 0 for k, _ in rows}


@pytest.mark.parametrize("dim", [3, 8, 16, 32, 64, 100])
def test_embedding_recall(spark, dim):
    """Pairs just above the threshold, at every length; the smallest ids hold malformed vectors."""
    rng = np.random.default_rng(dim)
    rows = [(0, [1.0]), (1, [2.0]), (2, []), (3, None)]
    while len(rows) < 304:
        a = rng.normal(size=dim)
        a /= np.linalg.norm(a)
        c = rng.normal(size=dim)
        c -= (c @ a) * a
        cos = rng.uniform(0.9, 0.93)
        b = cos * a + np.sqrt(1 - cos * cos) * c / np.linalg.norm(c)
        rows += [(len(rows), a.tolist()), (len(rows) + 1, (b * 7).tolist())]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = brute_links(rows)
    assert got[0] == got[1] == 1 and got[2] == got[3] == 0 and all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = np.concatenate([c + rng.normal(size=(12, 32)) * rng.choice([0.05, 0.3]) for c in centres]).astype(np.float32)
    x = np.concatenate([x, x[:5], x[7:8] * 3])
    good = [(i, v.tolist()) for i, v in enumerate(x)]
    good += [(3000 + i, [1.0, 2.0, float(i)]) for i in range(40)] + [(4000, [1e30] * 5), (4001, [1e-30] * 5), (4002, [1.0] * 5000), (4003, [1.0] * 4999 + [-1.0]), (4004, [5.0])]
    bad = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] * 32), (2005, [float("inf")] * 32), (2006, [])]
    rows = [(i, v, 1) for i, v in [*good, *bad, (None, x[0].tolist()), (None, x[0].tolist()), (None, None), (2000, None)]]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(0)).withColumn("weight", F.lit(0))).collect()
    want = brute_links([*good, *bad, (None, x[0].tolist())])
    assert len(got) == len(rows)
    links = {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] is not None}
    assert 0.9 * sum(want[k] for k in links) <= sum(links.values()) and all(links[k] <= want[k] for k in links)
    assert all(links[i] == 0 for i, _ in bad) and links[4000] == links[4002] == 1 and links[4004] == 0
    assert sorted(r["n_links"] for r in got if r["vec_id"] is None)[0] == 0
    keyless = [r for r in got if r["vec_id"] is None and r["n_links"]]
    assert len(keyless) == 2 and all(r["component_id"] == 0 and not r["kept"] and r["n_links"] == links[0] for r in keyless)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    nothing = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert tuple(embedding_dedup.near_duplicates(nothing).first()) == (1, 0, 1, True)
    assert embedding_dedup.near_duplicates(nothing.limit(0)).count() == 0
    shared = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [3.0, 0.1])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in embedding_dedup.near_duplicates(shared).collect()} == {(1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False)}


def test_large_bucket_is_dealt_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    rng = np.random.default_rng(6)
    x = (np.ones(16) + rng.normal(size=(300, 16)) * 0.02).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["n_links"] for r in got} == {299} and {r["component_id"] for r in got} == {0}


@pytest.mark.parametrize("make, label, rare, precision, recall", [(quality.classify, "quality", 0, 0.95, 0.9), (toxicity.classify, "toxic", 1, 0.95, 0.85)])
def test_held_out_precision_and_recall(spark, make, label, rare, precision, recall):
    """Of the rarer class: rejected texts, and toxic ones."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    scored = make(docs, labelled.read_labels(spark, sf, label))
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    rows = scored.join(truth, "doc_id").where("held_out").toPandas()
    hit = (rows["predicted"] == rare) & (rows[label] == rare)
    assert hit.sum() >= precision * (rows["predicted"] == rare).sum() and hit.sum() >= recall * (rows[label] == rare).sum()
    assert rows["score"].between(0, 1).all()


@pytest.mark.parametrize("make", [quality.classify, toxicity.classify, mixing.mix_documents])
def test_classifier_edges(spark, make):
    none = spark.createDataFrame([], "doc_id long, y int")
    some = spark.createDataFrame([(2, 1), (4, 0), (77, 1)], "doc_id long, y int")
    docs = frame(spark, EDGE).withColumn("y", F.lit("clash")).withColumn("score", F.lit("clash"))
    for labels in (none, some):
        assert make(docs, labels).count() == len(EDGE)
        assert make(docs.limit(0), labels).count() == 0


def test_label_model_discounts_repeated_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.1
    good = [(truth & (rng.random(4000) < 0.6)) | (rng.random(4000) < 0.001) for _ in range(6)]
    noise = rng.random(4000) < 0.05
    votes = np.stack([*good, *[noise] * 5], axis=1)
    post = toxicity.label_model(votes, 0.1)
    assert ((post > 0.5) == truth).mean() > 0.97


def test_toxicity_learns_rare_terms_but_not_copies(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    rare = ["".join(rng.choices("qrstuvwxyz", k=7)) for _ in range(20)]
    text = lambda extra: " ".join([*rng.choices(words, k=12), *extra, *rng.choices(words, k=12)])
    copy = text(["copiedword"])
    rows = [(text([w]), 1) for w in rare for _ in range(15)] + [(copy, 1)] * 100 + [(text([]), 0) for _ in range(2000)]
    ids = [i for i in range(4 * len(rows)) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in zip(ids, rows)], "doc_id long, text string, y int")
    model = toxicity.train(docs.drop("y"), docs.select("doc_id", "y"))
    known = lambda ws: set(toxicity._fires([w.encode() for w in ws], model.bases, model.known)[0].tolist())
    assert known(rare) == set(range(len(rare))) and not known(["copiedword"])
    toxic = model.score([text([w]).encode() for w in rare])
    clean = model.score([text(["copiedword"]).encode() for _ in range(20)])
    assert (toxic >= toxicity.THRESHOLD).mean() > 0.5 and (clean < toxicity.THRESHOLD).mean() >= 0.9


def test_each_toxicity_pattern_fires_on_its_text():
    plain = "one quiet line of text (with ordinary marks ~ and words)"
    texts = [plain + " no!!!", plain + " f**k", plain + " GO AWAY NOW", "go away " * 5, "go away\n" * 5, plain]
    fired = toxicity._patterns([t.encode() for t in texts])
    assert [np.flatnonzero(f).tolist() for f in fired] == [[0], [1], [2], [3], [3, 4], []]


def brute_label_model(votes, prior, rounds=30):
    """The same expectation-maximisation, one text and one voter at a time."""
    from math import exp, log, sqrt

    n, m = votes.shape

    def correlations(classes, strong):
        out = [[0.0] * m for _ in range(m)]
        cov = [[0.0] * m for _ in range(m)]
        for w, p in classes:
            for a in range(m):
                for b in range(m):
                    cov[a][b] += sum(w[i] for i in range(n) if votes[i][a] and votes[i][b]) - max(sum(w), 1e-9) * p[a] * p[b]
        scale = [sqrt(max(cov[a][a], 1e-9)) for a in range(m)]
        for a in range(m):
            for b in range(m):
                c = min(1.0, max(0.0, cov[a][b] / scale[a] / scale[b]))
                out[a][b] = c if a != b and c >= strong else 0.0
        return [1 + sum(row) for row in out]

    group = correlations([([1.0] * n, [sum(votes[i][a] for i in range(n)) / n for a in range(m)])], 0.8)
    post = [1 / (1 + exp(-4 * (sum(1 / group[a] for a in range(m) if votes[i][a]) - 1.5))) for i in range(n)]
    share = [1 / sqrt(g) for g in group]
    for step in range(rounds):
        clip = lambda x: min(1 - 1e-4, max(1e-4, x))
        p1 = [clip((sum(post[i] for i in range(n) if votes[i][a]) + 0.5) / (sum(post) + 1)) for a in range(m)]
        p0 = [clip((sum(1 - post[i] for i in range(n) if votes[i][a]) + 0.5) / (n - sum(post) + 1)) for a in range(m)]
        if step in (3, 10):
            share = [1 / sqrt(g) for g in correlations([(post, p1), ([1 - x for x in post], p0)], 0.5)]
        z = [log(prior / (1 - prior)) + sum(share[a] * (log(p1[a] / p0[a]) if votes[i][a] else log((1 - p1[a]) / (1 - p0[a]))) for a in range(m)) for i in range(n)]
        post = [1 / (1 + exp(-min(30, max(-30, x)))) for x in z]
    return post


def test_label_model_equals_brute_force():
    rng = np.random.default_rng(3)
    truth = rng.random(150) < 0.2
    votes = np.stack([*[(truth & (rng.random(150) < 0.7)) | (rng.random(150) < 0.02) for _ in range(4)], *[rng.random(150) < 0.1] * 2], axis=1)
    assert np.allclose(toxicity.label_model(votes, 0.2), brute_label_model(votes, 0.2), atol=1e-4)


def test_linear_classifier_equals_dense_descent():
    rng = np.random.default_rng(4)
    x, dense, target = rng.random((40, 7)) < 0.3, rng.normal(size=(40, 2)), rng.random(40)
    rows, columns = np.nonzero(x)
    w, d, c = toxicity.fit_linear(rows, columns, 40, 7, dense, target, steps=60)
    full, at = np.concatenate([x, dense, np.ones((40, 1))], axis=1), np.r_[np.zeros(9), -2.0]
    first, second = np.zeros(10), np.zeros(10)
    for t in range(1, 61):
        slope = np.array([sum((1 / (1 + np.exp(-full[i] @ at)) - target[i]) * full[i, k] for i in range(40)) / 40 + (1e-4 * at[k] if k < 9 else 0) for k in range(10)])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        at = at - 0.05 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(np.r_[w, d, c], at)


def two_kinds(rng, positive, mixed, share):
    n = int(mixed * share)
    return rng.normal(1, 1, (positive, quality.STATS)), np.concatenate([rng.normal(1, 1, (n, quality.STATS)), rng.normal(-1, 1, (mixed - n, quality.STATS))])


def test_risk_stays_non_negative_and_separates():
    positive, mixed = two_kinds(np.random.default_rng(0), 500, 1000, 0.7)
    model = quality.fit(positive, mixed, 0.7)
    score = model.score(mixed)
    assert ((score > 0.5) == (np.arange(1000) < 700)).mean() > 0.97
    good, bad = quality.risks(model, positive, mixed, 0.7)
    assert good >= 0 and bad > -0.02
    zu, zp = (np.array([sum(a * b for a, b in zip(row, model.weights)) for row in model.inputs(x)]) for x in (mixed, positive))
    assert np.isclose(bad, np.mean(np.log1p(np.exp(zu))) - 0.7 * np.mean(np.log1p(np.exp(zp)))) and np.isclose(good, 0.7 * np.mean(np.log1p(np.exp(-zp))))


def test_risk_descent_equals_brute_force():
    """Descent along numeric slopes of the risks: down on their sum, up on the negatives' where that is below zero."""
    positive, mixed = two_kinds(np.random.default_rng(2), 12, 20, 0.5)
    positive, mixed = positive * 3, mixed * 3
    want = quality.Model(np.concatenate([positive, mixed]).mean(0), np.concatenate([positive, mixed]).std(0) + 1e-6, np.zeros(2 * quality.STATS + 1))
    p, u, w = want.inputs(positive), want.inputs(mixed), want.weights
    good = lambda w: 0.5 * np.logaddexp(0, -p @ w).mean()
    bad = lambda w: np.logaddexp(0, u @ w).mean() - 0.5 * np.logaddexp(0, p @ w).mean()
    slope = lambda f, w: np.array([(f(w + e) - f(w - e)) / 2e-5 for e in np.eye(len(w)) * 1e-5])
    first, second, undone = np.zeros_like(w), np.zeros_like(w), 0
    for t in range(1, 41):
        undone += bad(w) < 0
        step = (slope(good, w) + slope(bad, w) if bad(w) >= 0 else -slope(bad, w)) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        w = w - 0.05 * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    assert undone and np.allclose(quality.fit(positive, mixed, 0.5, steps=40).weights, w, atol=2e-2)


@pytest.mark.parametrize("share", [0.3, 0.7, 0.9])
def test_prior_is_estimated_without_negatives(share):
    positive, mixed = two_kinds(np.random.default_rng(1), 1500, 4000, share)
    assert abs(quality.estimated_prior(positive, mixed) - share) < 0.05
    assert quality.estimated_prior(positive[:0], mixed) == 0.5


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = labelled.read_labels(spark, SF, "quality")
    model = mixing.train(docs, labels)
    members = common.stored(mixing.memberships(docs, model), "m")
    have = mixing.totals(members, np.zeros((0, 4)), 4)
    target = dict(zip(model.domains, (have * [1.5, 0.5, 2.0, 1.0]).tolist()))
    found = mixing.fit_rates(members, target, model.domains)
    rows = mixing.rated(members, found.steps, model.domains).toPandas()
    p = np.stack(members.select("doc_id", "p").toPandas().set_index("doc_id").loc[rows["doc_id"]]["p"].to_numpy())
    assert (rows["rate"] >= 0).all() and found.error <= mixing.CLOSE and not found.unreached
    assert np.allclose((rows["rate"] * rows["n_tokens"]).to_numpy() @ p, list(target.values()), rtol=1e-3)
    truth = docs.select("doc_id", "lang", "n_chars").toPandas().merge(rows, on="doc_id")
    long = truth[truth["n_chars"] > 300]
    assert (long["lang"] == long["domain"]).mean() > 0.95


@pytest.mark.parametrize("seed", range(3))
def test_mixing_finds_the_least_squares(spark, seed):
    """Targets that no rates meet: as near as a long plain descent in numpy; domains of any number."""
    rng = np.random.default_rng(seed)
    k = (3, 5, 80)[seed]
    p = rng.dirichlet(np.full(k, 0.5), 40)
    n = rng.integers(1, 100, 40).astype(float)
    scale = n @ p
    target = scale * rng.choice([0.0, 0.2, 4.0], k)
    rate = np.ones(40)
    for _ in range(20_000):
        rate = np.maximum(0, rate - p @ ((rate * n) @ p / scale - target / scale))
    least = (((rate * n) @ p - target) ** 2 / scale).sum()
    members = common.stored(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>").repartition(3), "m")
    names = [f"d{i:02}" for i in range(k)]
    with pytest.warns(UserWarning):
        found = mixing.fit_rates(members, dict(zip(names, target.tolist())) | {"none": 5.0}, [*names])
    got = (((mixing._rates(p, found.steps) * n) @ p - target) ** 2 / scale).sum()
    assert got <= least * 1.05 + 1e-3 * scale.sum() and np.isclose(found.error, np.abs(((mixing._rates(p, found.steps) * n) @ p - target) / scale).max())


def test_mixing_names_domains_without_tokens(spark):
    members = common.stored(spark.createDataFrame([(10, [1.0, 0.0])], "n_tokens long, p array<double>"), "m")
    with pytest.warns(UserWarning, match="unreached"):
        found = mixing.fit_rates(members, {"a": 20.0, "b": 5.0}, ["a", "b"])
    assert found.unreached == ("b",) and np.allclose(found.totals, [20, 0])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pseudonyms", "mixture", "tokens"]
    by = dict(corpus_pipeline.STAGES)
    kept = common.stored(by["quality"](spark, docs, SF), "q")
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").join(kept, "doc_id").count()
    assert kept.columns == docs.columns and bad <= 3 and kept.count() > 0.8 * docs.count()
    one = common.stored(by["near_duplicates"](spark, kept, SF), "n")
    classes = brute_classes([(r["doc_id"], r["text"]) for r in kept.collect()], 80, 5)
    assert {r["doc_id"] for r in one.collect()} == {c for _, _, c in classes} and one.columns == docs.columns
    hidden = common.stored(by["pseudonyms"](spark, one, SF), "p")
    assert hidden.columns == docs.columns and hidden.dtypes == docs.dtypes and hidden.count() == one.count()
    assert hidden.where("text rlike '555-[0-9]{4}'").count() < one.where("text rlike '555-[0-9]{4}'").count()
    mixed = common.stored(by["mixture"](spark, hidden, SF), "m")
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == hidden.count()
    model = mixing.train(hidden, labelled.read_labels(spark, SF, "quality"))
    once = mixing.memberships(hidden, model).toPandas()
    have = once["n_tokens"].to_numpy() @ np.stack(once["p"].to_numpy())
    want = np.array(list(mixing.tempered(have, model.domains, mixing.TEMPERATURE, True).values()))
    after = mixed.groupBy("doc_id").count().toPandas().merge(once, on="doc_id")
    reached = (after["n_tokens"] * after["count"]).to_numpy() @ np.stack(after["p"].to_numpy())
    assert (np.abs(reached / want - 1) < 0.1).all() and (np.abs(have / want - 1).max() > 0.3)
    tokens = by["tokens"](spark, mixed, SF)
    assert tokens.count() == mixed.count()
    text = mixed.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).distinct()
    assert tokens.join(text, "doc_id").where("h <> decoded_sha256").count() == 0


def test_near_duplicates_keep_one_row_of_a_group(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, a), (1, a), (2, a), (3, "alone in this table of rows"), (None, b), (None, b), (None, b.upper()), (None, a), (4, "x y"), (4, "z"), (None, ""), (None, None)]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]).lower()) for r in got) == sorted([("1", a), ("3", rows[3][1]), ("None", b), ("4", "x y"), ("None", ""), ("None", "none")])


def test_pipeline_on_edge_rows(spark):
    for rows in (EDGE, []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.stored(stage(spark, docs, SF), "edge")
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_embedding_keys_of_all_sizes(spark):
    near, far = [1.0, 0.0, 0.0, 0.0, 0.01], [0.0, 1.0, 0.0, 0.0, 0.0]
    rows = [(2**62 + 5, near), (2**62 + 9, near), (2**63 - 1, far), (-(2**63), far), (7, [0.0, 0.0, 1.0, 0.0, 0.0]), (-3, None)]
    got = {tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(2**62 + 5, 1, 2**62 + 5, True), (2**62 + 9, 1, 2**62 + 5, False), (2**63 - 1, 1, -(2**63), False), (-(2**63), 1, -(2**63), True), (7, 0, 7, True), (-3, 0, -3, True)}
    # Rows without a key link, and tell no component.
    rows += [(None, near), (None, [0.0, 0.0, 0.0, 1.0, 0.0]), (None, None)]
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert {(2**62 + 5, 2, 2**62 + 5, True), (2**62 + 9, 2, 2**62 + 5, False), (None, 2, 2**62 + 5, False), (None, 0, None, False), (2**63 - 1, 1, -(2**63), False)} <= set(got) and got.count((None, 0, None, False)) == 2
