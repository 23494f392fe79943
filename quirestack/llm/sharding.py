"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a hash.  A bucket over the byte limit splits on the next
bit, and only such buckets split, so a bucket's depth is the smallest number of leading bits at which
its bytes fit.  The bytes of all prefixes follow from one aggregation over fine cells of hash space;
rows never move until their shard is known.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored

#: Leading bits of the hash that can be told apart.
BITS = 60
#: Bits of the first cells beyond those that shards of even sizes would need, and bits that each later look adds.
FINER, DEEPER = 3, 9
#: Bytes of text in a shard of the registered query, at most.
SHARD_BYTES = 1 << 20


def hash_bits(key: Column, text: Column) -> Column:
    """60 bits of MD5 over the key and the text's MD5; a null key or text is left out."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.md5(text.cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int, bits: int, above: int = 0) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_docs, fits) of every bucket of hash space that is no deeper than bits.

    rows: (h, bytes).  Depths below `above` are known to be over the limit.  A bucket is a prefix that fits, or
    can't be told apart further here, and whose parent doesn't fit; every prefix has one parent, so no key of this join is hot.
    """
    cells = rows.groupBy(F.shiftright("h", BITS - bits).alias("cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    # Neighbours lie together, so that sums of prefixes are nearly done before they are shuffled.
    cells = stored(cells.repartitionByRange("cell"), "cells")
    level = F.explode(F.sequence(F.lit(above), F.lit(bits))).alias("depth")
    nodes = cells.select("cell", "b", "n", level).groupBy("depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix"))
    nodes = nodes.agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")).withColumn("fits", F.col("shard_bytes") <= limit)
    nodes = stored(nodes, "nodes")
    ends = nodes.where(F.col("fits") | (F.col("depth") == bits))
    parents = nodes.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    below = ends.where(F.col("depth") > above).withColumn("up", F.shiftright("prefix", 1)).join(parents.hint("merge"), ["depth", "up"], "left_semi").drop("up")
    return ends.where(F.col("depth") == above).unionByName(below)


def _cells(buckets: DataFrame, bits: int) -> DataFrame:
    """buckets with a row for each cell of the given number of bits; the cells of all buckets are hash space itself."""
    first = F.expr(f"shiftleft(prefix, {bits} - depth)")
    last = F.expr(f"shiftleft(prefix + 1, {bits} - depth) - 1")
    return buckets.withColumn("cell", F.explode(F.sequence(first, last)))


def bucketed(rows: DataFrame, limit: int) -> DataFrame:
    """rows, which hold h and bytes, with depth, prefix, shard_bytes, shard_docs and fits of the bucket each falls in.

    The directory grows with the data, and files understate it: it is merged with the rows, never broadcast.
    Rows whose bucket needs more bits than the cells have are looked at again, they alone.
    """
    total = rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    bits, above, out = min(BITS, max(0, ceil(log2(max(1, total / limit))) + FINER)), 0, None
    while True:
        buckets = stored(directory(rows, limit, bits, above), "directory")
        settled = buckets if bits == BITS else buckets.where("fits")
        rows = rows.withColumn("cell", F.shiftright("h", BITS - bits))
        done = rows.join(_cells(settled, bits).hint("merge"), "cell").drop("cell")
        out = done if out is None else out.unionByName(done)
        over = buckets.where("not fits").select(F.col("prefix").alias("cell"))
        if bits == BITS or over.isEmpty():
            return out
        rows = stored(rows.join(over.hint("merge"), "cell", "left_semi").drop("cell"), "rows")
        above, bits = bits + 1, min(BITS, bits + DEEPER)


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return stored(docs.select(F.col(key).alias("id"), hash_bits(F.col(key), F.col(text)).alias("h"), size.alias("bytes")), "rows")


# A bucket that never fits is as deep as the hash goes, whether it holds one row or many.
_NAME = "CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END"


def shard(docs: DataFrame, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, shard, depth, shard_bytes, shard_docs, fits) for every row.

    shard: the bucket's leading bits as text, '' when one shard holds all.  Null and empty texts have
    no bytes.  fits is false only where splitting can't help: a single row over the limit, or equal
    rows, which share all bits, that are over it together; these reach a depth of 60 bits or stand
    alone.  An empty table has no shards.  Other columns are left aside.
    """
    out = bucketed(_rows(docs, text, key), limit)
    return out.select(F.col("id").alias(key), F.expr(_NAME).alias("shard"), "depth", "shard_bytes", "shard_docs", "fits")


def write_shards(docs: DataFrame, limit: int, path: str, text: str = "text", key: str = "doc_id", into: str = "shard") -> None:
    """Writes docs, all columns and rows, as one Parquet folder a shard, named by the column `into`, which docs must not have.

    A row's shard follows from its hash, so null and repeated keys are placed like others.  The shard of
    an undivided table is named '-', as a folder needs a name.
    """
    shards = bucketed(_rows(docs, text, key), limit).select(F.col("h").alias("_h"), F.expr(_NAME).alias(into)).distinct()
    named = shards.withColumn(into, F.when(F.col(into) == "", "-").otherwise(F.col(into)))
    placed = docs.withColumn("_h", hash_bits(F.col(key), F.col(text))).join(named.hint("merge"), "_h").drop("_h")
    placed.repartition(into).write.partitionBy(into).parquet(path)


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), SHARD_BYTES)


op9_extendible_sharding_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS b,
         ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, md5(text))), 1, {BITS // 4}))::BIGINT AS h
  FROM documents),
levels AS (SELECT unnest(generate_series(0, {BITS})) AS depth),
sums AS (
  SELECT depth, h >> ({BITS} - depth)::INT AS prefix, sum(b) AS shard_bytes, count(*) AS shard_docs
  FROM r, levels GROUP BY ALL),
leaf AS (
  SELECT h, min(depth) AS depth
  FROM (SELECT DISTINCT h FROM r), sums
  WHERE prefix = h >> ({BITS} - depth)::INT AND (shard_bytes <= {SHARD_BYTES} OR depth = {BITS})
  GROUP BY h)
SELECT r.doc_id, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(s.prefix), l.depth::INT, '0') END AS shard,
       l.depth::INT AS depth, s.shard_bytes::BIGINT AS shard_bytes, s.shard_docs AS shard_docs,
       s.shard_bytes <= {SHARD_BYTES} AS fits
FROM r JOIN leaf l ON r.h = l.h JOIN sums s ON s.depth = l.depth AND s.prefix = r.h >> ({BITS} - l.depth)::INT
"""
