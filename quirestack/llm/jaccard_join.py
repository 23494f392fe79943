"""N-gram Jaccard join by parity sketches.

Every distinct shingle flips one bit of a sketch, so two sketches differ in no more bits than their
sets differ in shingles.  Within a band of set sizes the threshold bounds that difference by D, the
sketch is cut into a ring of more blocks than D, and by the pigeonhole principle linked sets agree in
whole blocks.  Equal blocks join documents; the blocks after an equal one, a finer sketch, and at last
the shingles themselves decide.  No link is lost: see block_keys.  Work inside large buckets and
large candidate classes is dealt in tiles that return trees, never all pairs.
"""

from __future__ import annotations

from math import exp, floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Prefix, blocks, components, documents, mix, small_batches, stored, words_of
from .features import WHITE

#: Natural logarithm of the ratio of the largest to the smallest set size of a band.
BAND = 0.3
#: Bits of the deciding sketch for each shingle.
FINE = 2
#: Blocks after an equal one that a pair is held against.
RING = 4
#: Buckets of more sets than this are searched in tiles of about so many; smaller ones are joined to pairs.
SMALL, TILE = 8, 1024
#: Shingles in a tile of a candidate class, about.
TILE_SHINGLES = 1 << 18


# ---- shingles --------------------------------------------------------------------------------


def shingle_sets(part: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted: A-Z lower-cased, words parted by ASCII white space.

    A text of fewer words than width has its whole sequence as one shingle; one without words has none.
    """
    low, start, end, first = words_of(part, WHITE)
    word = Prefix(low).hash(start, end)
    rolled = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - width + 1 + k]) if len(rolled) else rolled
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in word[a:b]:
                    whole = mix(np.array([whole * np.uint64(0x9E3779B97F4A7C15) + h]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ---- sketches --------------------------------------------------------------------------------


class Plan:
    """Bands, blocks and bounds for links of intersection * 100 >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent
        self.least = percent / 100

    def difference(self, a, b):
        """The largest symmetric difference of linked sets of sizes a and b."""
        return np.floor((100 - self.percent) * (np.asarray(a, np.int64) + b) / (100 + self.percent) + 1e-9).astype(np.int64)

    def top(self, band: int) -> int:
        """The largest size in a band."""
        return floor(exp((band + 1) * BAND) + 1e-9)

    def bands(self, n: int) -> list[int]:
        """The bands in which a set of n shingles meets its partners: its own, and those above in which a larger partner may lie."""
        return list(range(self.band(n), self.band(floor(n / self.least + 1e-9)) + 1))

    def band(self, n: int) -> int:
        k = max(0, int(log(n) / BAND) - 1)
        while self.top(k) < n:
            k += 1
        return k

    def blocks(self, band: int) -> tuple[int, int]:
        """(D, number of blocks) of a band: two sets that meet in it differ in at most D shingles if linked."""
        d = int(self.difference(self.top(band), self.top(band)))
        return d, d + 1 + (2 + d // 12 if d else 0)


def block_keys(hashes: np.ndarray, plan: Plan) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(band, block numbers, block values, what follows each block) of one set.

    A block's value is a fingerprint of the bits set in that block of the sketch; what follows are the
    next RING blocks, folded to a byte each.  Differences of linked sets add up to D over the ring of
    m blocks, so by the cycle lemma at least m - D blocks are equal and start runs in which any k
    blocks differ in fewer than k bits.  A set with fewer blank blocks than that leaves them out: one
    of those starts isn't blank.  Other sets emit their blank blocks too, under numbers of their own,
    and meet each other there.
    """
    out = []
    for band in plan.bands(len(hashes)):
        d, m = plan.blocks(band)
        mixed = mix(hashes + np.uint64(band + 1))
        block = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        low = mixed & np.uint64(0xFFFFFFFF)
        order = np.argsort(block, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(block[order]) > 0])
        value, folded = np.zeros(m, np.uint64), np.zeros(m, np.uint8)
        value[block[order[at]]] = np.bitwise_xor.reduceat((mix(low) | np.uint64(1))[order], at)  # one of 2**32 bits of the block
        folded[block[order[at]]] = np.bitwise_xor.reduceat(np.left_shift(1, (low & np.uint64(7)).astype(np.uint8)).astype(np.uint8)[order], at)
        ring = np.zeros((m, 8), np.uint8)
        for k in range(min(RING, m - 1)):
            ring[:, k] = np.roll(folded, -k - 1)
        ring = ring.view("<i8")[:, 0]
        full = np.flatnonzero(value)
        if m - len(full) >= m - d:
            out.append((band, np.where(value == 0, np.arange(m) + m, np.arange(m)), value, ring))
        else:
            out.append((band, full, value[full], ring[full]))
    return out


def fine_sketch(hashes: np.ndarray, plan: Plan) -> list[tuple[int, np.ndarray]]:
    """(band, parity sketch as 64-bit words) of one set for each band it meets partners in."""
    out = []
    for band in plan.bands(len(hashes)):
        words = FINE * plan.top(band) // 64 + 1
        mixed = mix(hashes ^ np.uint64(0x5BF0A8B1) * np.uint64(band + 1))
        at = ((mixed >> np.uint64(32)) * np.uint64(words * 64) >> np.uint64(32)).astype(np.int64)
        bits = (np.bincount(at, minlength=words * 64) & 1).astype(np.uint8)
        out.append((band, np.packbits(bits).view(np.int64)))
    return out


# ---- the join --------------------------------------------------------------------------------

def _digest(h: np.ndarray) -> int:
    """A fingerprint of a whole set."""
    return int(np.bitwise_xor.reduce(mix(h + np.uint64(len(h)))).view(np.int64)) if len(h) else 0


def sketched(docs: DataFrame, plan: Plan, width: int, text: str, key: str) -> DataFrame:
    """id, n, node (a digest of the whole set) and for each band the fine sketch."""

    def run(batches):
        kind = pa.list_(pa.struct([("band", pa.int32()), ("sketch", pa.list_(pa.int64()))]))
        for batch in batches:
            ids = batch.column(0)
            for a, b, part in blocks(batch.column(1).to_pylist()):
                sets = shingle_sets(part, width)
                rows = [[{"band": band, "sketch": sketch} for band, sketch in fine_sketch(h, plan)] if len(h) else [] for h in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(h) for h in sets], pa.int64()), pa.array([_digest(h) for h in sets], pa.int64()), pa.array(rows, kind)],
                    ["id", "n", "node", "bands"],
                )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "id long, n long, node long, bands array<struct<band:int,sketch:array<long>>>")


def keyed(docs: DataFrame, plan: Plan, width: int, text: str, key: str) -> DataFrame:
    """(key, band, node, ring) for every block of every set, each set once in a slice of rows."""

    def run(batches):
        for batch in batches:
            for _, _, part in blocks(batch.column(0).to_pylist()):
                nodes, bands, keys, rings, seen = [], [], [], [], set()
                for h in shingle_sets(part, width):
                    if not len(h) or (node := _digest(h)) in seen:
                        continue
                    seen.add(node)
                    for band, number, value, ring in block_keys(h, plan):
                        rings.append(ring)
                        nodes.append(np.full(len(value), node, np.int64))
                        bands.append(np.full(len(value), band, np.int32))
                        keys.append(mix(value + mix(number.astype(np.uint64) + np.uint64(band << 32))).view(np.int64))
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, bands, nodes, rings)], ["key", "band", "node", "ring"])

    return docs.where(F.col(key).isNotNull()).select(F.col(text).alias("t")).mapInArrow(run, "key long, band int, node long, ring long")


def shingles_of(docs: DataFrame, width: int, text: str, key: str, bitmap: np.ndarray) -> DataFrame:
    """(id, n, s) with the shingle hashes of documents whose id's bit is set; other ids are only passed by chance."""
    size = np.uint64(len(bitmap) * 8)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            slot = mix(ids.astype(np.int64).view(np.uint64)) % size
            keep = np.flatnonzero((bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            if not len(keep):
                continue
            texts = batch.column(1).take(pa.array(keep)).to_pylist()
            for a, b, part in blocks(texts):
                sets = [h.view(np.int64) for h in shingle_sets(part, width)]
                ends = np.cumsum([0] + [len(h) for h in sets], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep[a:b]].astype(np.int64)), lists], ["id", "s"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "id long, s array<long>")


#: Bits of the filter that keeps texts without candidates out of the second pass: 1 MiB whatever the input.
#: Where more ids are marked it passes more texts than needed; the join behind it is what decides.
FILTER_BITS = 1 << 23


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, made of partial bitmaps by tasks."""

    def run(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[(mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
        rows = np.packbits(bits, bitorder="little").reshape(256, -1)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([rows[i].tobytes() for i in some], pa.binary())], ["r", "bits"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        both = np.bitwise_or.reduce(np.stack([np.frombuffer(b, np.uint8) for b in frame["bits"]]))
        return pd.DataFrame({"r": [frame["r"].iloc[0]], "bits": [both.tobytes()]})

    parts = ids.mapInArrow(run, "r long, bits binary").groupBy("r").applyInPandas(merge, "r long, bits binary").collect()
    out = np.zeros((256, FILTER_BITS // 8 // 256), np.uint8)
    for r in parts:
        out[r["r"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _side(sets: DataFrame, x: str) -> DataFrame:
    each = sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.explode("bands").alias("s"))
    return each.select(x, f"n_{x}", F.col("s.band").alias("band"), F.col("s.sketch").alias(f"s_{x}"))


def _near(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Of the pairs of nodes (x, y, band) those whose fine sketches differ in no more bits than linked sets may differ in shingles."""
    joined = pairs.join(_side(sets, "x"), ["x", "band"]).join(_side(sets, "y"), ["y", "band"])
    apart = F.aggregate(F.zip_with("s_x", "s_y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    most = F.floor((100 - plan.percent) * (F.col("n_x") + F.col("n_y")) / F.lit(100 + plan.percent) + F.lit(1e-9))
    return joined.where(apart <= most).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _tiled(rows: DataFrame, group: list[str], node: str, tiles: Column) -> DataFrame:
    """rows of each group dealt to all pairs of its tiles, sorted so that a pair of tiles lies together."""
    dealt = rows.withColumn("_t", tiles.cast("int")).withColumn("_tile", F.pmod(F.xxhash64(node, F.lit(9)), F.col("_t")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("_o")
    dealt = dealt.select("*", other).withColumn("tile_a", F.least("_tile", "_o")).withColumn("tile_b", F.greatest("_tile", "_o")).drop("_t", "_tile", "_o")
    return dealt.repartition(*group, "tile_a", "tile_b").sortWithinPartitions(*group, "tile_a", "tile_b")


def _by_group(group: list[str], search):
    """A mapInPandas function that hands search the frame of each group of sorted rows; groups may span batches."""
    by = [*group, "tile_a", "tile_b"]

    def run(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            new = np.flatnonzero((held[by].to_numpy()[1:] != held[by].to_numpy()[:-1]).any(1)) + 1
            cuts = [0, *new.tolist()]
            found = [search(held.iloc[a:b]) for a, b in zip(cuts, cuts[1:])]
            if found:
                yield pd.DataFrame(np.concatenate(found), columns=["a", "b"])
            held = held.iloc[cuts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield pd.DataFrame(search(held), columns=["a", "b"])

    return run


def _tree(count: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest, found breadth first; near(i, rest): which of rest are linked with i."""
    rest, edges = np.arange(count), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            edges += [(i, j) for j in rest[hit].tolist()]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return edges


def _pairs_of(ids: np.ndarray, edges: list[tuple[int, int]]) -> np.ndarray:
    e = np.array(edges, np.int64).reshape(-1, 2)
    return ids[e]


def _search_sketches(plan: Plan):
    """A forest over the nodes of a bucket whose fine sketches are near enough."""

    def search(frame: pd.DataFrame) -> np.ndarray:
        sketch = np.stack(frame["s_x"].to_numpy()).view(np.uint64)
        n = frame["n_x"].to_numpy()

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            return np.bitwise_count(sketch[rest] ^ sketch[i]).sum(1) <= plan.difference(n[rest], n[i])

        return _pairs_of(frame["x"].to_numpy(), _tree(len(frame), near))

    return search


def _search_sets(plan: Plan):
    """A forest over the sets of a candidate class that are linked, by their whole intersections."""

    def search(frame: pd.DataFrame) -> np.ndarray:
        sets = frame["s"].to_list()
        size = np.array([len(x) for x in sets])
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(token, kind="stable")
        holders, first = owner[order], np.r_[0, np.cumsum(np.bincount(token))]
        begin = np.r_[0, np.cumsum(size)]

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            own = token[begin[i] : begin[i + 1]]
            length = first[own + 1] - first[own]
            spots = np.repeat(first[own] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
            same = np.bincount(holders[spots], minlength=len(sets))[rest]
            return 100 * same >= plan.percent * (size[rest] + size[i] - same)

        return _pairs_of(frame["id"].to_numpy(), _tree(len(frame), near))

    return search


def _candidates(docs: DataFrame, sets: DataFrame, plan: Plan, width: int, text: str, key: str) -> DataFrame:
    """Pairs of nodes (a, b) whose connected classes hold every link: near pairs, or trees of them."""
    # The blocks are shuffled once; most have no partner and end at this filter.
    bucket = Window.partitionBy("key")
    rows = keyed(docs, plan, width, text, key).withColumn("lo", F.min("node").over(bucket)).withColumn("hi", F.max("node").over(bucket)).where("lo <> hi")
    rows = stored(rows.groupBy("key", "band", "node").agg(F.first("ring").alias("ring")), "blocks")
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("node")).alias("members"))
    shared = stored(rows.join(buckets, "key"), "buckets")
    small = shared.where(F.col("k") <= SMALL)
    apart = F.col("ring_x").bitwiseXOR(F.col("ring_y"))
    follows = [F.bit_count(apart.bitwiseAND(F.lit((1 << 8 * k) - 1))) <= k for k in range(1, RING + 1)]
    left = small.select("key", "band", F.col("node").alias("x"), F.col("ring").alias("ring_x"))
    right = small.select("key", F.col("node").alias("y"), F.col("ring").alias("ring_y"))
    pairs = left.join(right, "key").where(F.col("x") < F.col("y"))
    for f in follows:
        pairs = pairs.where(f)
    near = _near(pairs.select("x", "y", "band").distinct(), sets, plan)
    # Of large buckets with the same members one is searched.
    large = shared.where(F.col("k") > SMALL)
    once = large.groupBy("band", "k", "members").agg(F.min("key").alias("key"))
    rows = large.join(once.select("key"), "key").select("key", "band", "k", F.col("node").alias("x")).join(_side(sets, "x"), ["x", "band"])
    dealt = _tiled(rows.select("key", "k", "x", "n_x", "s_x"), ["key"], "x", F.ceil(F.col("k") / TILE))
    return near.union(dealt.drop("k").mapInPandas(_by_group(["key"], _search_sketches(plan)), "a long, b long"))


def _verified(classes: DataFrame, sets: DataFrame, docs: DataFrame, plan: Plan, width: int, text: str, key: str) -> DataFrame:
    """Links (a, b) between documents that stand for nodes, enough to connect what is linked; classes: (id, component) of nodes."""
    members = stored(classes.join(sets.select(F.col("node").alias("id"), "rep", "n"), "id").select("component", F.col("rep").alias("id"), "n"), "members")
    size = members.groupBy("component").agg(F.ceil(F.sum("n") / TILE_SHINGLES).alias("tiles"))
    placed = members.select("component", "id").join(size, "component")
    found = shingles_of(docs, width, text, key, _bitmap(members.select("id"))).where(F.size("s") > 0)
    dealt = _tiled(placed.join(found, "id"), ["component"], "id", F.col("tiles"))
    return dealt.drop("tiles").mapInPandas(_by_group(["component"], _search_sets(plan)), "a long, b long")


def join(docs: DataFrame, percent: int, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs.

    Two documents link when 100 * intersection >= percent * union of their shingle sets; component_id
    is the smallest key reachable by links.  Null and empty texts, and texts without words, have no
    shingles and link with nothing.  Rows with a null key come back with a null component and link
    with nothing; rows that share a key are one document with several texts.  Keys are integers.

    1. Documents with equal sets are one node, told by the smallest key; only nodes go on.
    2. Nodes that share a bucket and pass the sketches are candidates; their connected classes hold
       every link.
    3. Inside a class sets are compared by their intersections until all that is linked is connected.
    """
    plan = Plan(percent)
    rows = stored(sketched(small_batches(docs), plan, width, text, key), "sketched")
    sets = rows.where("id is not null and n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = stored(sets, "sets")
    classes = components(_candidates(docs, sets, plan, width, text, key))
    links = stored(_verified(classes, sets, docs, plan, width, text, key), "linked")
    first = stored(components(links), "components")
    # Rows of one key are linked, too.
    equal = rows.where("id is not null").select("id", "n", "node").join(sets.select("node", "rep"), "node", "left")
    placed = equal.join(first.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep", "id").alias("component_id"))
    several = placed.groupBy("id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi")
    if not several.isEmpty():
        bridges = placed.join(several.select("id"), "id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))
        merged = components(bridges).select(F.col("id").alias("component_id"), F.col("component").alias("m"))
        placed = placed.join(merged, "component_id", "left").withColumn("component_id", F.coalesce("m", "component_id")).drop("m")
    none = rows.where("id is null").select("id", "n", F.lit(None).cast("long").alias("component_id"))
    return placed.unionByName(none).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir), percent=85, width=4)
