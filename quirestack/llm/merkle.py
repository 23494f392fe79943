"""Merkle manifest of a dataset: leaves, subroots of sources, a root, and a proof for every row.

Children are events.  A task keeps a partial parent for each run of siblings it has begun, adds indexed child
digests to it, and emits the parent once it has the arity that the tree's size demands; the parent is an event
in turn, so whole subtrees climb in one pass.  Runs cut by a task's borders leave their children open; these
frontiers, a few rows a level and task, are shuffled to ever fewer tasks until all roots are known.  Proofs follow
the links back: nodes above blocks of equal height are looked up once a block, and each block's rows are proved
where the block is, so no row carries a proof through a shuffle.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored

#: Children of a node.
ARITY = 3
#: Levels of a block, whose rows are proved together: at most ARITY ** HEIGHT rows.
HEIGHT = 6
#: Open children that meet in one task of the next round.
FRONTIER = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_POWERS = [ARITY**k for k in range(40) if ARITY**k < 1 << 62]
NODE = "tree long, level int, idx long, size long, digest string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each '-' if null, else its UTF-8 byte count, ':' and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def width(size: int, level: int) -> int:
    """Nodes of a level in a tree of size leaves."""
    return -(-size // ARITY**level)


def climbed(rows: DataFrame) -> DataFrame:
    """(NODE, open) that one pass over rows of NODE makes.

    Nodes of level HEIGHT and above and all roots are returned with open false; children whose parent lacks others, with
    open true.  Partial parents are held only until their run is whole, so
    in rows sorted by tree and place a task holds a few a level.
    """

    keep = HEIGHT

    def run(batches):
        partial: dict[tuple, dict] = {}
        for batch in batches:
            made: list[tuple] = []
            for event in zip(*(batch.column(c).to_pylist() for c in ("tree", "level", "idx", "size", "digest"))):
                while True:
                    tree, level, idx, size, digest = event
                    n = width(size, level)
                    if n == 1:
                        break
                    parent = idx // ARITY
                    run_of = partial.setdefault((tree, level + 1, parent, size), {})
                    run_of[idx] = digest
                    if len(run_of) < min(ARITY, n - ARITY * parent):
                        break
                    del partial[tree, level + 1, parent, size]
                    event = (tree, level + 1, parent, size, sha("".join(run_of[i] for i in sorted(run_of))))
                    if level + 1 >= keep or width(size, level + 1) == 1:
                        made.append((*event, False))
            yield _nodes(made)
        yield _nodes([(tree, level - 1, idx, size, digest, True) for (tree, level, _, size), run_of in partial.items() for idx, digest in run_of.items()])

    return rows.select("tree", "level", "idx", "size", "digest").mapInArrow(run, f"{NODE}, open boolean")


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"tree": pa.int64(), "level": pa.int32(), "idx": pa.int64(), "size": pa.int64(), "digest": pa.string(), "open": pa.bool_()}
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def nodes_of(leaves: DataFrame) -> DataFrame:
    """NODE of level HEIGHT and above, and all roots, of trees whose leaves are (tree, idx, size, digest); stored."""
    events = leaves.select("tree", F.lit(0).alias("level"), "idx", "size", "digest")
    done = events.where("size = 1")
    place = F.col("idx") * F.element_at(F.array(*map(F.lit, _POWERS)), F.col("level") + 1)
    while True:
        made = stored(climbed(events), "nodes")
        done = done.unionByName(made.where("NOT open").drop("open"))
        frontier = made.where("open").drop("open")
        rows = frontier.count()
        if not rows:
            return stored(done, "nodes")
        events = frontier.repartitionByRange(-(-rows // FRONTIER), "tree", place) if rows > FRONTIER else frontier.coalesce(1)
        events = events.sortWithinPartitions("tree", place)


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with idx, the place from 0 within the group, and size, the group's rows; nulls come first; stored.

    Rows are dealt by ranges of group and order, so a group of any size is spread, and only counts of a task's part of
    a group are summed. Equal rows are spread as well; their order is left to the layout of the input.
    """
    by = [*group, *order]
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*by, "_at").sortWithinPartitions(*by, "_at").withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("_part", F.shiftright("_at", 33)), "ordered")
    parts = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_of_{c}") for c in group], (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_from"), F.sum("_n").over(whole).alias("size"))
    joined = placed.join(parts, [F.col("_part") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]])
    return joined.select(*rows.columns, (F.col("_at") + F.col("_from")).alias("idx"), "size")


PROOF = "array<struct<left:string,right:string>>"


def _paths(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, block, path) for every block: level by level from the block's top, siblings before and after, joined; every block has a row."""
    powers = F.array(*map(F.lit, _POWERS))
    blocks = leaves.where(F.col("idx") % ARITY**HEIGHT == 0).select("tree", F.expr(f"idx div {ARITY**HEIGHT}").alias("block"), "size")
    levels = F.filter(F.sequence(F.lit(HEIGHT), F.lit(len(_POWERS) - 1)), lambda k: F.element_at(powers, k + 1) < F.col("size"))
    steps = blocks.withColumn("level", F.explode(levels)).withColumn("_p", F.element_at(powers, F.col("level") + 1))
    steps = steps.withColumn("_own", F.expr(f"block div (_p div {ARITY**HEIGHT})")).withColumn("_run", F.expr(f"_own div {ARITY}"))
    steps = steps.withColumn("idx", F.explode(F.expr(f"sequence(_run * {ARITY}, least(_run * {ARITY} + {ARITY - 1}, (size - 1) div _p))")))
    steps = steps.where("idx <> _own").select("tree", "block", "level", "idx", (F.col("idx") < F.col("_own")).alias("left"))
    found = steps.join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
    lists = found.groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("level", "idx", "left", "digest"))).alias("near"))
    rows = blocks.join(lists, ["tree", "block"], "left").withColumn("levels", levels)

    def side(k: Column, left: bool) -> Column:
        chosen = F.filter(F.col("near"), lambda s: (s["level"] == k) & (s["left"] == F.lit(left)))
        return F.coalesce(F.array_join(F.transform(chosen, lambda s: s["digest"]), ""), F.lit(""))

    path = F.transform("levels", lambda k: F.struct(side(k, True).alias("left"), side(k, False).alias("right")))
    return rows.select("tree", "block", path.alias("path"))


def proved(leaves: DataFrame, nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """leaves with top, the root of their tree, and proof: a step a level with the run's other digests before and after, joined.

    leaves: (tree, idx, size, digest) and columns that are passed on.  above: (tree, more), steps that follow the tree's own.
    """
    paths = _paths(leaves, nodes)
    if above is not None:
        paths = paths.join(above, "tree").select("tree", "block", F.concat("path", "more").alias("path"))
    tops = nodes.where(F.col("size") <= F.element_at(F.array(*map(F.lit, _POWERS)), F.col("level") + 1)).select("tree", F.col("digest").alias("top"))
    paths = paths.join(tops, "tree").select(F.col("tree").alias("in_tree"), F.col("block").alias("in_block"), "path", "top")
    rows = leaves.withColumn("block", F.expr(f"idx div {ARITY**HEIGHT}"))
    kept = list(leaves.columns)

    def run(mine: pa.Table, path: pa.Table) -> pa.Table:
        mine = mine.sort_by("idx")
        size, digests = mine.column("size")[0].as_py(), mine.column("digest").to_pylist()
        higher, top = path.column("path")[0].as_py(), path.column("top")[0].as_py()
        proofs = [[] for _ in digests]
        level, nodes_here = 0, digests
        while level < HEIGHT and width(size, level) > 1:
            for i, steps in enumerate(proofs):
                j = i // ARITY**level
                run_of = j - j % ARITY
                steps.append({"left": "".join(nodes_here[run_of:j]), "right": "".join(nodes_here[j + 1 : run_of + ARITY])})
            nodes_here = [sha("".join(nodes_here[k : k + ARITY])) for k in range(0, len(nodes_here), ARITY)]
            level += 1
        step = pa.struct([("left", pa.string()), ("right", pa.string())])
        out = mine.select(kept).append_column("proof", pa.array([p + higher for p in proofs], pa.list_(step)))
        return out.append_column("top", pa.array([top] * len(digests), pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields)
    return rows.groupBy("tree", "block").cogroup(paths.groupBy("in_tree", "in_block")).applyInArrow(run, f"{schema}, proof {PROOF}, top string")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row for every row of docs: doc_id, source, leaf, subroot, root, proof and other_leaf.

    Leaves hold doc_id, source, lang, n_chars and text, nulls told from empty values.  Those of a source stand by
    doc_id, null first, and then by digest; equal rows have equal digests, and each has a place and a proof.  Subroots stand by
    source, null first.  A source's only leaf is its subroot, a table's only subroot its root.  Texts may be of any
    length; an empty table has no rows and no root.  Other columns of docs are not looked at.
    changed: columns that replace docs' own for other_leaf, the digest of another version of the row; without, it equals leaf.
    """
    other = [(changed or {}).get(c, F.col(c)) for c in FIELDS]
    rows = docs.select("doc_id", "source", leaf_digest([F.col(c) for c in FIELDS]).alias("digest"), leaf_digest(other).alias("other_leaf"))
    rows = stored(ranked(rows, ["source"], ["doc_id", "digest"]), "leaves")
    order = ranked(rows.select("source").distinct().withColumn("all", F.lit(0)), ["all"], ["source"])
    names = stored(order.select(F.col("source").alias("name"), F.col("idx").alias("tree"), F.col("size").alias("trees")), "sources")
    rows = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).select("tree", "idx", "size", "digest", "doc_id", "source", "other_leaf")
    rows = stored(rows.sortWithinPartitions("tree", "idx"), "leaves")
    nodes = nodes_of(rows)
    is_top = F.col("size") <= F.element_at(F.array(*map(F.lit, _POWERS)), F.col("level") + 1)
    subroots = nodes.where(is_top).select("tree", "digest").join(names.select("tree", "trees"), "tree")
    subroots = stored(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("size"), "digest").sortWithinPartitions("idx"), "subroots")
    upper = proved(subroots, nodes_of(subroots))
    upper = stored(upper.select(F.col("idx").alias("tree"), F.col("proof").alias("more"), F.col("top").alias("root")), "upper")
    out = proved(rows, nodes, upper.drop("root")).join(upper.select("tree", "root"), "tree")
    return out.select("doc_id", "source", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "proof", "other_leaf")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    rows = manifest(docs, {"text": F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    digests = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.col("other_leaf"), F.col("proof"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(digests.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
op11_merkle_manifest_SQL = f"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
          lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
rows0 AS (
  SELECT d.*, row_number() OVER () AS row_id,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
          lambda c, b: xor(c // 256, crc.t[(xor(c, b) % 256) + 1])), 4294967295) % 2 AS odd
  FROM documents d, crc),
leaf0 AS (
  SELECT row_id, doc_id, source,
    sha256({" || ".join(_FIELD.format(c) for c in FIELDS)}) AS leaf,
    sha256({" || ".join(_FIELD.format(c if c != "text" else "(CASE WHEN odd = 0 THEN replace(text, chr(10), '') ELSE text END)") for c in FIELDS)}) AS other
  FROM rows0),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size
  FROM leaf0),
trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS tree, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
low(tree, level, idx, size, digest) AS (
  SELECT tree, 0, idx, size, leaf FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source
  UNION ALL
  SELECT tree, level + 1, idx // {ARITY}, (size + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx))
  FROM low WHERE size > 1 GROUP BY tree, level, idx // {ARITY}, size),
high(tree, level, idx, size, digest) AS (
  SELECT 0, 0, t.tree - 1, t.n, l.digest FROM low l JOIN trees t ON l.tree = t.tree WHERE l.size = 1
  UNION ALL
  SELECT tree, level + 1, idx // {ARITY}, (size + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx))
  FROM high WHERE size > 1 GROUP BY tree, level, idx // {ARITY}, size),
tops AS (SELECT max(level) AS top FROM low),
nodes AS (SELECT tree, level, idx, size, digest FROM low UNION ALL SELECT 0, level + 1000, idx, size, digest FROM high),
steps AS (
  SELECT l.row_id, a.level, s.idx, s.idx < a.idx AS is_left, s.digest
  FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source
  JOIN nodes a ON (a.tree = t.tree AND a.idx = l.idx // pow({ARITY}, a.level)::BIGINT) OR (a.tree = 0 AND a.idx = (t.tree - 1) // pow({ARITY}, a.level - 1000)::BIGINT)
  JOIN nodes s ON s.tree = a.tree AND s.level = a.level AND s.idx // {ARITY} = a.idx // {ARITY}
  WHERE a.size > 1),
sides AS (
  SELECT row_id, level, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (is_left), '') AS lft,
         coalesce(string_agg(digest, '' ORDER BY idx) FILTER (NOT is_left AND NOT own), '') AS rgt
  FROM (SELECT s.*, s.idx = min(s.idx) FILTER (NOT is_left) OVER (PARTITION BY row_id, level) AS own FROM steps s) GROUP BY row_id, level),
paths AS (
  SELECT row_id, sha256(string_agg(lft || rgt, '' ORDER BY level)) AS proof_sha256, list(lft ORDER BY level) AS ls, list(rgt ORDER BY level) AS rs
  FROM sides GROUP BY row_id),
folded(row_id, k, h) AS (
  SELECT row_id, 1, other FROM leaves
  UNION ALL
  SELECT f.row_id, k + 1, sha256(p.ls[k] || h || p.rs[k]) FROM folded f JOIN paths p ON f.row_id = p.row_id WHERE k <= len(p.ls))
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = r.digest AS verified
FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source
JOIN low s ON s.tree = t.tree AND s.size = 1
JOIN (SELECT digest FROM high WHERE size = 1) r ON true
LEFT JOIN paths p ON p.row_id = l.row_id
JOIN (SELECT row_id, arg_max(h, k) AS h FROM folded GROUP BY row_id) f ON f.row_id = l.row_id
"""
