"""Which rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots into which ids fall when a sample is drawn.
_SLOTS = 1 << 30


def held_out(doc_id: Column) -> Column:
    """True for rows that are never learned from: crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def read_labels(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(doc_id, y) of the labels that may be learned from; where labels of one id differ, the smallest counts."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"))


def _made(rows: DataFrame, of: Callable[[Column], Column] | None) -> DataFrame:
    return rows.withColumn("text", of(F.col("text"))) if of else rows


def _one_each(rows: DataFrame, key: str, of: Callable[[Column], Column] | None) -> DataFrame:
    """One row for each key, the smallest; rows whose keys are all different, as most tables' are, stay where they are."""
    others = [c for c in rows.columns if c != key]
    if not others:
        return rows.distinct()
    if rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        return _made(rows, of)
    return _made(rows, of).groupBy(key).agg(F.min(F.struct(*others)).alias("_r")).select(key, "_r.*")


def about(rows: DataFrame, key: str, bound: int, salt: int, of: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows if there are at most bound, else one row for each key in a share of hash space that holds about bound rows.

    The sample stays distributed.  Of rows that share a key the smallest is taken, so one key never
    fills it, and the sample doesn't depend on the layout of the input.  of: what is made of the column text
    where the rows are, so that texts needn't be shuffled.
    """
    n = rows.count()
    if n <= bound:
        return _made(rows, of)
    slot = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(_SLOTS))
    return _one_each(rows.where(slot < int(_SLOTS * bound / n)), key, of)


def labelled_texts(docs: DataFrame, labels: DataFrame, bound: int, salt: int = 1, of: Callable[[Column], Column] | None = None) -> DataFrame:
    """(text, y) of at most about bound labelled rows; the ids that are sent to all tasks are bounded by it.

    Rows that share an id count once: labels speak of ids, and the smallest of the texts, or of what `of` makes
    of them where they are, stands for it.
    """
    chosen = about(labels, "doc_id", bound, salt)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return _one_each(rows, "doc_id", of).select("text", "y")
