"""Helpers shared by the training-data operators: shared storage, batches of bytes, connected classes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a temporary folder is taken, but only if all runs on one machine (tests); a cluster raises.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="quirestack-")
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


#: Bytes of a batch of rows that is handed to Python, about; a longer row stands alone.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df; batches handed to Python are bounded by BATCH_BYTES unless the session sets a bound of its own.

    The JVM's vectors, the arrays and the strings of a batch are held by each task at once, several times its bytes.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: a short lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes tables that stored() wrote and that nothing reads any more."""
    for df in tables:
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in links: the smallest id reachable.

    Alternating large-star and small-star rounds over the distinct links; each round is two
    aggregations, its result is written to the shared folder in place of the last one's, and the number
    of rounds grows with the logarithm of the longest path.  Nothing but one count a round reaches the driver.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    settled = False
    while not settled:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        after = stored(
            small.select("u", F.col("m").alias("v"))
            .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "links",
        )
        discard(edges)
        edges = after
        # A fixed point is a forest of stars: no centre is itself a member.
        if after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            settled = after.groupBy("u").count().where("count > 1").isEmpty()
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.union(roots).select(F.col("u").alias("id"), F.col("v").alias("component"))


_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _POWERS:
        up = np.full(size, _P, np.uint64)
        down = np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        both = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 21:  # too large to keep for one long text
            return both
        _POWERS[size] = both
    return _POWERS[size]


class Prefix:
    """Rolling sums of a byte array, from which the hash of any slice follows in constant time."""

    def __init__(self, data: np.ndarray):
        self._up, self._down = _powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self._up[: len(data)], out=self._sum[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * self._down[start]
        return mix(h + (end - start).astype(np.uint64))


def blocks(texts, limit: int = 1 << 20):
    """Slices (from, to, texts as UTF-8 bytes) of a batch of at most about limit bytes; a longer text stands alone."""
    begin, size, part = 0, 0, []
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "replace") if isinstance(t, str) else b""
        if part and size + len(raw) > limit:
            yield begin, i, part
            begin, size, part = i, 0, []
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield begin, begin + len(part), part


def words_of(part: list[bytes], separator: np.ndarray):
    """Words of several texts at once: (lower-cased bytes as an array, word starts, word ends, first word of each text).

    separator: 256 flags of the bytes that part words; A-Z are lower-cased first.
    """
    data = np.frombuffer(b"\n".join(part).lower() + b"\n", np.uint8)
    gap = separator[data]
    flips = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=np.int8(1)))
    start, end = flips[0::2], flips[1::2]
    at = np.cumsum([0] + [len(x) + 1 for x in part])
    return data, start, end, np.searchsorted(start, at)
