"""Embedding near-duplicates by iterative quantisation.

Rotations are learned that turn vectors into balanced binary codes; several of them give independent
codes.  The codes, end to end, are cut into substrings that index Hamming tables: vectors that agree on
a whole substring meet in its bucket, where the original vectors are compared by cosine.  Substrings grow
with the logarithm of the number of vectors, so that strangers seldom meet, and there are as many tables
as the recall at the threshold then asks for, whatever the vectors' length.  Buckets of any size are dealt
in tiles, and a pair that meets in several buckets counts in the first alone.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stored
from .labelled import about

#: Vectors that the rotations are learned from, at most about, and numbers in them.
SAMPLE, SAMPLE_VALUES = 20_000, 1 << 23
#: Bits of a substring, from and to; more vectors than the longest tells apart make larger buckets.
BITS_FROM, BITS_TO = 8, 32
#: Bits of a code at most; a shorter vector's code has as many bits as it has components.
CODE_BITS = 64
#: Codes whose rotations are learned, at most, and for each bit of a code; a short vector has more codes than its
#: space has best rotations, so the rest stay random.
LEARNED, LEARNED_A_BIT = 64, 2
#: Share of the pairs just at the threshold that should meet in a table, were all bits to agree independently.
RECALL = 0.97
#: Lengths of vectors that get rotations of their own learned, the most frequent first; vectors of other
#: lengths are indexed by their random starting rotations, in the same tables.
LENGTHS = 16
#: Components that a rotation takes; those of longer vectors are folded onto so many by seeded signs first.
FOLDED = 4096
#: Vectors in a tile of a bucket; a larger bucket is compared tile by tile.
TILE = 2048
THRESHOLD = 0.9


def substring_bits(n: int) -> int:
    """Bits at which about one of n vectors with random codes shares a given one's bucket."""
    return min(BITS_TO, max(BITS_FROM, ceil(log2(max(1, n)))))


def tables(threshold: float, bits: int, recall: float = RECALL) -> int:
    """Hamming tables needed: vectors at the threshold's angle agree in a bit with probability 1 - angle / pi."""
    agree = (1 - acos(min(1.0, max(-1.0, threshold))) / pi) ** bits
    return 1 if agree >= recall else ceil(log(1 - recall) / log(1 - agree))


def learn(sample: np.ndarray, count: int, rounds: int = 30, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """(origin, projection) of each code by iterative quantisation: orthogonal directions, turned to lower the error of their signs.

    Codes start from random rotations, so they err apart; without a sample, and beyond those to be learned, they stay there.  Every other
    code is taken about the mean, which balances its bits; the others keep the origin, so that copies agree
    even where one group of them is most of the sample and the mean lies in its middle.
    count: bits in all, at least.
    """
    n = sample.shape[1]
    width = min(n, CODE_BITS)
    out = []
    for code in range(ceil(count / max(1, width))):
        rng = np.random.default_rng((seed, code))
        turn = np.linalg.qr(rng.normal(size=(n, width)))[0]
        origin = sample.mean(0) * (code % 2) if len(sample) else np.zeros(n)
        v = sample - origin
        for _ in range(rounds if len(sample) and code < min(LEARNED, LEARNED_A_BIT * width) else 0):
            left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v, full_matrices=False)
            turn = (left @ right).T
        out.append((origin, turn))
    return out


def folded(x: np.ndarray) -> np.ndarray:
    """Rows of x, longer ones than FOLDED added up on so many places under seeded signs, which keeps angles nearly."""
    n = x.shape[1]
    if n <= FOLDED:
        return x
    sign = np.random.default_rng(n).choice([-1.0, 1.0], n)
    padded = np.zeros((len(x), -(-n // FOLDED) * FOLDED))
    padded[:, :n] = x * sign
    return padded.reshape(len(x), -1, FOLDED).sum(1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of x, none zero, at length one, whatever their size."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def encode(vectors: np.ndarray, projections: list[tuple[np.ndarray, np.ndarray]], count: int, bits: int) -> np.ndarray:
    """The table keys of each unit vector: one column for each of count substrings of its codes, laid end to end."""
    sign = np.concatenate([(vectors - origin) @ p >= 0 for origin, p in projections], axis=1)[:, : count * bits]
    weight = 1 << np.arange(bits, dtype=np.int64)
    return sign.reshape(len(vectors), count, bits) @ weight


def _usable(embedding: str) -> Column:
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: x != 0)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


#: Buckets of up to so many vectors are compared together, many buckets at once.
SMALL = 24


def _pairs(bucket: np.ndarray):
    """(i, j) with i < j of rows in one small bucket; bucket: ascending bucket numbers."""
    size = np.bincount(bucket)[bucket] if len(bucket) else np.zeros(0, int)
    small = size <= SMALL
    for d in range(1, min(SMALL, len(bucket))):
        i = np.flatnonzero(small[:-d] & (bucket[d:] == bucket[:-d]))
        if not len(i):
            return
        yield i, i + d


def _links(table, bucket, tile, crossing, keys, x, threshold):
    """Linked pairs (i, j) of rows in one bucket.

    crossing: the bucket is one pair of tiles, whose inner pairs are compared elsewhere.  A pair that
    an earlier table holds in one bucket has counted there.
    """
    order = np.arange(keys.shape[1])
    out_i, out_j = [], []

    def keep(i, j):
        good = ~crossing[i] | (tile[i] != tile[j])
        i, j = i[good], j[good]
        i, j = (v[((keys[i] == keys[j]) & (order < table[i][:, None])).sum(1) == 0] for v in (i, j))
        out_i.append(i)
        out_j.append(j)

    for i, j in _pairs(bucket):
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        keep(i[near], j[near])
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    end = np.r_[start[1:], len(bucket)]
    for a, b in zip(start[end - start > SMALL].tolist(), end[end - start > SMALL].tolist()):
        for c in range(a, b, 512):
            i, j = np.nonzero(x[c : min(c + 512, b)] @ x[a:b].T >= threshold)
            i, j = i + c, j + a
            keep(i[i < j], j[i < j])
    return np.concatenate([np.zeros(0, int), *out_i]), np.concatenate([np.zeros(0, int), *out_j])


_BUCKET = ["size", "table", "code", "tile_a", "tile_b"]


def _compare(threshold: float):
    """Over rows sorted by bucket: each vector's number of links, and for each bucket links that join its components."""

    def of_one_size(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = (frame[_BUCKET].to_numpy()[1:] != frame[_BUCKET].to_numpy()[:-1]).any(1)
        bucket = np.r_[0, np.cumsum(bucket)]
        x = unit(np.stack(frame["v"].to_numpy()).astype(np.float64))
        keys = np.stack([np.frombuffer(c, np.uint32) for c in frame["codes"]])
        ids, weight = frame["id"].to_numpy(), frame["weight"].to_numpy()
        crossing = (frame["tile_a"] != frame["tile_b"]).to_numpy()
        i, j = _links(frame["table"].to_numpy(), bucket, frame["tile"].to_numpy(), crossing, keys, x, threshold)
        links = np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))
        root = _roots(len(ids), i, j)
        out = links > 0
        return pd.DataFrame({"id": ids[out], "hash": frame["hash"].to_numpy()[out], "links": links[out].astype(np.int64), "root": ids[root[out]]})

    def whole(frame: pd.DataFrame):
        for _, part in frame.groupby("size", sort=False):
            yield of_one_size(part)

    def run(frames):
        held = None  # the last bucket may go on in the next batch; buckets are bounded by two tiles
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            same = (held[_BUCKET] == held[_BUCKET].iloc[-1]).all(axis=1).to_numpy()
            begin = len(held) - int(np.argmin(same[::-1])) if not same.all() else 0
            if begin:
                yield from whole(held.iloc[:begin])
                held = held.iloc[begin:].reset_index(drop=True)
        if held is not None and len(held):
            yield from whole(held)

    return run


def _learned(distinct: DataFrame, count: int) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Projections for each of the LENGTHS most frequent lengths; only bounded samples reach the driver."""
    found = distinct.groupBy("size").count().orderBy(F.desc("count"), "size").limit(LENGTHS).collect()
    out = {}
    for size in [r["size"] for r in found if r["count"] > 1]:
        bound = min(SAMPLE, max(1, SAMPLE_VALUES // size))
        sample = about(distinct.where(F.col("size") == size).select("hash", "v"), "hash", bound, salt=5).select("v").toPandas()["v"]
        if len(sample):
            out[size] = learn(folded(unit(np.stack(sample.to_numpy()).astype(np.float64))), count)
    return out


def _named(rows: DataFrame) -> DataFrame:
    """rows of (key, v) with id: the key, or for rows without one a hash of the vector that isn't any row's key."""
    salt, keys = 0, rows.where("key IS NOT NULL").select(F.col("key").alias("taken")).distinct()
    while True:
        made = F.xxhash64(F.lit(salt), "v")
        if rows.where("key IS NULL").select(made.alias("taken")).join(keys, "taken", "left_semi").isEmpty():
            return rows.withColumn("id", F.coalesce("key", made))
        salt += 1


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, n_links, component_id, kept) for every row of vectors.

    Two vectors link when they have the same length, their cosine in double precision is at least
    threshold, and some substring of their codes agrees; equal vectors always link.  Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing.  Rows that share a key are
    one vector if equal; otherwise each has its own row and the key is one node.  Rows without a key link
    like others, equal ones as one vector; where no key is reachable their component is null, and they are
    never kept.  kept: the key is its component's smallest.  Keys are integers of 64 bits.  Other columns
    are left aside.
    """
    of = vectors.schema[embedding].dataType.elementType.simpleString()
    of = of if of in ("float", "double") else "double"
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast(f"array<{of}>").alias("v"))
    # Equal vectors, -0.0 and 0.0 alike, are compared once.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(of)))
    keyless = not rows.where("key IS NULL").isEmpty()
    rows = _named(rows) if keyless else rows.withColumn("id", F.col("key"))
    members = rows.where(_usable("v")).select("id", "v").distinct()
    distinct = members.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    # A vector is told by its smallest key and its hash: a key may have several vectors.
    distinct = stored(distinct.withColumn("size", F.size("v")).withColumn("hash", F.xxhash64("v")), "vectors")
    bits = substring_bits(distinct.count())
    count = tables(threshold, bits)
    projections = _learned(distinct, count * bits)

    def codes(frames):
        known = dict(projections)
        for frame in frames:
            for size, part in frame.groupby("size"):
                if size not in known:
                    known = {**projections, size: learn(np.zeros((0, min(size, FOLDED))), count * bits)}
                keys = encode(folded(unit(np.stack(part["v"].to_numpy()).astype(np.float64))), known[size], count, bits)
                yield part.assign(keys=list(keys), codes=[k.tobytes() for k in keys.astype(np.uint32)])

    coded = stored(distinct.mapInPandas(codes, f"v array<{of}>, id long, weight long, size int, hash long, keys array<long>, codes binary"), "codes")
    entries = coded.select("id", "hash", "size", F.posexplode("keys").alias("table", "code"))
    sizes = entries.groupBy("size", "table", "code").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    tiles = F.ceil(F.col("k") / TILE).cast("int")
    placed = entries.join(sizes, ["size", "table", "code"]).withColumn("tiles", tiles)
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("id", "hash"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    dealt = placed.select("id", "hash", "size", "table", "code", "tile", other).select(
        "id", "hash", "size", "table", "code", "tile", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b")
    )
    work = dealt.join(coded.select("id", "hash", "size", "v", "weight", "codes"), ["id", "hash", "size"]).repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "id")
    found = stored(work.mapInPandas(_compare(threshold), "id long, hash long, links long, root long"), "links")
    counts = found.groupBy("id", "hash").agg(F.sum("links").alias("links"))
    same = members.join(distinct.select("v", F.col("id").alias("rep"), "hash", "weight"), "v").select("id", "rep", "hash", "weight")
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(same.select("id", "rep"))
    placed_in = components(edges)
    linked = same.join(counts.withColumnRenamed("id", "rep"), ["rep", "hash"], "left")
    linked = linked.groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n"))
    out = rows.select("key", "id").join(linked, "id", "left").join(placed_in, "id", "left")
    component = F.coalesce("component", "id")
    if keyless:  # a component is told by the smallest key in it, if it has one
        keyed = rows.where("key IS NOT NULL").select("id").distinct().join(placed_in, "id").groupBy("component").agg(F.min("id").alias("smallest"))
        out = out.join(keyed, "component", "left")
        component = F.coalesce("smallest", "key")
    return out.select(
        F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept")
    )


def op1_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
