"""Prefix trie of conversations: nodes are distinct sequences of first turns, with members, children, leaves and savings.

Turns are dictionary-encoded: one row for each distinct turn, by digest, gets an integer, and a conversation is an
array of them.  Equal conversations are one sequence with a weight.  Sequences are dealt by MSD radix: a bucket
holds those that share a prefix; it skips what all of them share, is split by the next turn, and its parts are split on
until they are small enough for one task.  There multikey quicksort finishes a bucket, and each of its equal
partitions is a node.  Leaves and savings of the split buckets are summed back over their parts, round by round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored

#: A bucket is finished in one task if it has at most so many sequences and turns, or is a single sequence.
LOCAL_SEQUENCES, LOCAL_TURNS = 1024, 1 << 18
#: Characters of ids that are hashed at once.
PIECE = 1 << 16
#: Nodes handed on at once.
BATCH = 20_000
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, chars): the dictionary ids of each conversation's turns in order, and their lengths in code points; stored."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).alias("chars"))
    terms = turns.groupBy("digest").agg(F.max("chars").alias("chars"))
    terms = stored(terms.withColumn("id", F.monotonically_increasing_id()), "terms")
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "digest", "id", "chars")
    rows = turns.drop("chars").join(terms, "digest").groupBy("conv_id").agg(F.array_sort(F.collect_list(place)).alias("turns"))
    return stored(rows.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars")), "encoded")


def rebuilt(rows: DataFrame) -> DataFrame:
    """Conversations whose first h turns are those of the first of their hundred; h: crc32 of the decimal id modulo 6."""
    most = 5
    heads = rows.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("head_ids"), F.slice("chars", 1, most).alias("head_chars"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = rows.join(heads, F.expr("conv_id - conv_id % 100") == F.col("base"), "left").withColumn("h", h)

    def put(head: str, own: str) -> Column:
        first = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast("array<long>" if own == "ids" else "array<int>"))
        return F.concat(first, F.slice(own, F.col("h") + 1, F.greatest(F.lit(0), F.size(own) - F.col("h"))))

    return both.select("conv_id", put("head_ids", "ids").alias("ids"), put("head_chars", "chars").alias("chars"))


def ends_of(members: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the decimal ids of each key's rows (key, conv_id), ascending and comma-joined.

    Ids are dealt by ranges of key and id, so one key may have any number of them; each task joins its part of a key to
    pieces of PIECE characters, and one task a key only runs the hash over the pieces: the hash itself is a chain.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (k != key or size >= PIECE):
                    out.append((key, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield made(out)
        yield made([(key, first, ",".join(ids))] if ids else [])

    def made(rows: list) -> pa.RecordBatch:
        k, c, t = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(c, pa.int64()), pa.array(t, pa.string())], names=["key", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
                if state is None or k != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield digests(out)
        yield digests([(key, state.hexdigest())] if state else [])

    def digests(rows: list) -> pa.RecordBatch:
        k, t = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(t, pa.string())], names=["key", "ends"])

    dealt = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = dealt.mapInArrow(pieces, "key binary, first long, piece string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends string")


def sequences(rows: DataFrame) -> DataFrame:
    """(conv, n, ids, chars, ends) of every distinct sequence: smallest conversation, how many, and the hash of all their ids; stored."""
    keyed = rows.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)))
    keyed = stored(keyed, "rebuilt")
    one = keyed.groupBy("key").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.min(F.struct("ids", "chars")).alias("turns"))
    one = stored(one.select("key", "conv", "n", "turns.ids", "turns.chars"), "sequences")
    copied = ends_of(keyed.join(one.where("n > 1").select("key"), "key", "left_semi"))
    alone = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    return stored(one.join(copied, "key", "left").select("conv", "n", "ids", "chars", F.coalesce("ends", alone).alias("ends")), "sequences")


def _buckets(rows: DataFrame, by: list[str]) -> DataFrame:
    """What is known of each group of rows that share a prefix: its size, its smallest conversation and how far all its sequences agree."""
    found = rows.groupBy(*by).agg(
        F.min("conv").alias("top"), F.count(F.lit(1)).alias("seqs"), F.sum("n").alias("n_convs"), F.sum(F.size("ids").cast("long")).alias("turns"),
        F.min(F.struct("ids", "chars")).alias("least"), F.max("ids").alias("most"),
    )
    parts = F.array_position(F.zip_with("least.ids", "most", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
    local = (F.col("seqs") == 1) | ((F.col("seqs") <= LOCAL_SEQUENCES) & (F.col("turns") <= LOCAL_TURNS))
    return found.select(*by, "top", "n_convs", local.alias("local"), F.when(parts > 0, parts - 1).otherwise(F.size("least.ids")).alias("at"), F.col("least.chars").alias("chars"))


def finished(rows: DataFrame) -> DataFrame:
    """NODES of local buckets; rows: (top, depth, parent, conv, n, ids, chars, ends), where top and depth name the bucket.

    Each bucket is sorted by multikey quicksort in the task that has it; buckets follow one another, and only one is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("top", "depth", "parent", "conv", "n", "ids", "chars", "ends"))):
                if bucket is not None and row[:3] != bucket:
                    out += multikey(held, bucket[1], bucket[2])
                    held = []
                bucket = row[:3]
                held.append(row[3:])
                while len(out) >= BATCH:
                    yield _nodes(out[:BATCH])
                    out = out[BATCH:]
        if held:
            out += multikey(held, bucket[1], bucket[2])
        for k in range(0, len(out), BATCH):
            yield _nodes(out[k : k + BATCH])

    return rows.repartition("top", "depth").sortWithinPartitions("top", "depth").mapInArrow(run, NODES)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in NODES.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def multikey(rows: list[tuple], depth: int, parent: int | None) -> list[tuple]:
    """NODES of the trie below a prefix of depth turns that all rows (conv, n, ids, chars, ends) share; their ids are distinct.

    A partition is split at a pivot into rows whose next turn is smaller, equal or larger; the rows of the equal
    part, which share a turn more, are a child.  A stack stands for the recursion, so sequences may be of any length.
    """
    nodes: list[list] = []  # conv, depth, parent's place, n_convs, children, leaves, saved, ends
    work = [(rows, depth, -1, True)]
    while work:
        part, d, at, whole = work.pop()
        if whole:
            n = sum(r[1] for r in part)
            own = (n - 1) * part[0][3][d - 1] if d else 0
            if at >= 0:
                nodes[at][4] += 1
            nodes.append([min(r[0] for r in part), d, at, n, 0, 0, own, EMPTY])
            at = len(nodes) - 1
        mid = part[len(part) // 2][2]
        pivot = mid[d] if len(mid) > d else -1
        less, same, more = [], [], []
        for r in part:
            x = r[2][d] if len(r[2]) > d else -1
            (same if x == pivot else less if x < pivot else more).append(r)
        if pivot >= 0:
            work.append((same, d + 1, at, True))
        else:
            nodes[at][7] = same[0][4]
        work += [(p, d, at, False) for p in (less, more) if p]
    for conv, d, at, n, children, leaves, saved, ends in reversed(nodes):
        pass_on = leaves if children else 1
        if at >= 0:
            nodes[at][5] += pass_on
            nodes[at][6] += saved
    return [
        (conv, d, nodes[at][0] if at >= 0 else parent, n, children, leaves if children else 1, saved, ends, at < 0)
        for conv, d, at, n, children, leaves, saved, ends in nodes
    ]


def trie(rows: DataFrame) -> DataFrame:
    """One row for each node of the trie of (conv_id, ids, chars), see op13_prefix_trie; the root's parent is null.

    An empty table has no nodes.  ids and chars of one conversation stand in a row, so 12 bytes a turn must fit a task.
    """
    seqs = sequences(rows)
    root = _buckets(seqs.withColumn("all", F.lit(0)), ["all"]).select("top", "n_convs", "local", "at", "chars", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"))
    root = stored(root, "buckets")
    first = root.select("top", "local", "at").first()
    if first is None:
        return seqs.sparkSession.createDataFrame([], NODES).drop("top")
    here = {"top": F.lit(first["top"]), "depth": F.lit(0), "parent": F.lit(None).cast("long"), "at": F.lit(first["at"])}
    rows = seqs.withColumns(here)
    if first["local"]:
        return finished(rows).drop("top")
    rounds, small, ends = [root], None, None
    while True:
        digit = F.when(F.size("ids") > F.col("at"), F.element_at("ids", F.col("at") + 1))
        rows = rows.select("top", "depth", "at", "conv", "n", "ids", "chars", "ends", digit.alias("digit"))
        stop = rows.where("digit IS NULL").select("top", "depth", "ends")
        ends = stop if ends is None else ends.unionByName(stop)
        going = rows.where("digit IS NOT NULL")
        parts = stored(_parts(going), "buckets")
        below = parts.select(F.col("parent").alias("of"), F.col("parent_depth").alias("of_depth"), F.col("digit").alias("of_digit"), *[F.col(c).alias(f"next_{c}") for c in ("top", "depth", "at", "local")])
        moved = going.join(below, [F.col("top") == F.col("of"), F.col("depth") == F.col("of_depth"), F.col("digit") == F.col("of_digit")])
        moved = stored(moved.select(F.col("next_top").alias("top"), F.col("next_depth").alias("depth"), F.col("top").alias("parent"), F.col("next_at").alias("at"), "conv", "n", "ids", "chars", "ends", F.col("next_local").alias("local")), "rows")
        done = moved.where("local").drop("local", "at")
        small = done if small is None else small.unionByName(done)
        rounds.append(parts)
        rows = moved.where("NOT local").drop("local")
        if parts.where("NOT local").isEmpty():
            break
    nodes = stored(finished(small), "nodes")
    sums = nodes.where("top").select("conv_id", "depth", "n_leaves", "saved_tokens")
    out = nodes.drop("top")
    for k in range(len(rounds) - 1, 0, -1):
        parts, wide = rounds[k], rounds[k - 1].where("NOT local")
        total = parts.select(F.col("top").alias("conv_id"), "depth", "parent", "parent_depth").join(sums, ["conv_id", "depth"])
        total = total.groupBy(F.col("parent").alias("top"), F.col("parent_depth").alias("depth")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.count(F.lit(1)).alias("parts"))
        chain = stored(_chain(wide.join(total, ["top", "depth"]), ends), "nodes")
        out = out.unionByName(chain.drop("head"))
        heads = chain.where("head").select("conv_id", "depth", "n_leaves", "saved_tokens")
        sums = heads if k == 1 else sums.unionByName(heads)
    return out


def _parts(going: DataFrame) -> DataFrame:
    """The buckets that buckets (top, depth), which agree up to at, are split into by the turn that follows, digit."""
    found = _buckets(going.select(F.col("top").alias("parent"), F.col("depth").alias("parent_depth"), (F.col("at") + 1).alias("depth"), "digit", "conv", "n", "ids", "chars"), ["parent", "parent_depth", "depth", "digit"])
    return found.select("parent", "parent_depth", "depth", "digit", "top", "n_convs", "local", "at", "chars")


def _chain(wide: DataFrame, ends: DataFrame) -> DataFrame:
    """NODES, head in place of top, of split buckets: one a depth from the bucket's own to the one at which it is split."""
    saved = F.aggregate(F.slice("chars", F.greatest(F.col("k"), F.lit(1)), F.col("at") - F.greatest(F.col("k"), F.lit(1)) + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = wide.join(ends.select("top", "depth", "ends"), ["top", "depth"], "left").withColumn("k", F.explode(F.sequence("depth", "at")))
    split = F.col("k") == F.col("at")
    return rows.select(
        F.col("top").alias("conv_id"), F.col("k").cast("long").alias("depth"), F.when(F.col("k") == F.col("depth"), F.col("parent")).otherwise(F.col("top")).alias("parent_conv_id"),
        "n_convs", F.when(split, F.col("parts")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * saved).alias("saved_tokens"),
        F.coalesce(F.when(split, F.col("ends")), F.lit(EMPTY)).alias("ends_sha256"), (F.col("k") == F.col("depth")).alias("head"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """NODES of the rebuilt conversations of (conv_id, turn, role, text).

    Turns are ordered by turn, null first, and equal numbers by the digest of role and text; a null role or text is
    empty, and rows without a conv_id belong to no conversation.  Repeated rows are turns of their own.  Other columns
    are left aside.
    """
    return trie(rebuilt(encoded(small_batches(conversations))))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


op13_prefix_trie_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
         ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
counted AS (
  SELECT own.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
         lambda c, b: xor(c // 256, crc.t[(xor(c, b) % 256) + 1])), 4294967295) % 6 AS h
  FROM own, crc),
seqs AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS seq
  FROM counted c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
steps AS (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM seqs),
member AS (SELECT conv_id, d, len(seq) AS n, seq[1:d] AS pre, min(conv_id) OVER (PARTITION BY d, seq[1:d]) AS node FROM steps),
nodes AS (
  SELECT node AS conv_id, d AS depth, count(*) AS n_convs,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(any_value(pre)[d].t) END AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM member GROUP BY node, d),
up AS (SELECT DISTINCT m.node AS conv_id, m.d AS depth, p.node AS parent FROM member m JOIN member p ON p.conv_id = m.conv_id AND p.d = m.d - 1),
kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
below AS (
  SELECT a.node AS conv_id, a.d AS depth, b.node AS sub, b.d AS sub_depth
  FROM member a JOIN member b ON b.conv_id = a.conv_id AND b.d >= a.d GROUP BY ALL),
sums AS (
  SELECT b.conv_id, b.depth, sum(n.own) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM below b JOIN nodes n ON n.conv_id = b.sub AND n.depth = b.sub_depth
  LEFT JOIN kids k ON k.conv_id = b.sub AND k.depth = b.sub_depth GROUP BY ALL)
SELECT n.conv_id, n.depth, up.parent AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.conv_id = n.conv_id AND s.depth = n.depth
LEFT JOIN kids k ON k.conv_id = n.conv_id AND k.depth = n.depth
LEFT JOIN up ON up.conv_id = n.conv_id AND up.depth = n.depth
"""
