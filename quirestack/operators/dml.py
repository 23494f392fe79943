"""Writes as DataFrame algebra: every operator returns the table as it is afterwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.keyed import Machine, over_batch


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of new replace those of equal key; of several new rows the last by order counts."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    latest = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return old.join(latest, key, "left_anti").unionByName(latest)


def deleted_and_kept(df: DataFrame, doomed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    return df.join(doomed, key, "left_semi"), df.join(doomed, key, "left_anti")


def cascade(tables: dict[str, tuple[DataFrame, str]], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows whose column refers to a doomed key."""
    ids = doomed.select(F.col(key).alias("_gone")).distinct()
    return {name: df.join(ids, df[column] == ids["_gone"], "left_anti") for name, (df, column) in tables.items()}


def merge_patch(old: DataFrame, patch: DataFrame, key: str, state: str, stamp: str, at: str) -> DataFrame:
    """The latest patch of each key: 'new' deletes the row, 'read' stamps it, any other state clears the stamp."""
    last = patch.groupBy(key).agg(F.max_by(F.struct(F.col(state).alias("s"), F.col(at).alias("t")), F.struct(at, state)).alias("p"))
    joined = old.join(last, key, "full_outer")
    stamped = F.when(F.col("p").isNull(), F.col(stamp)).when(F.col("p.s") == "read", F.col("p.t"))
    rows = joined.where(F.col("p").isNull() | (F.col("p.s") != "new"))
    return rows.select(key, F.coalesce("p.s", state).alias(state), stamped.alias(stamp))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old, key, "left_anti"))


def all_or_nothing(rows: DataFrame, valid: Column) -> DataFrame:
    """All rows if every one is valid, else none; the verdict is one aggregated row, joined back."""
    verdict = rows.agg(F.min(F.coalesce(valid, F.lit(False))).alias("_ok"))
    return rows.crossJoin(F.broadcast(verdict)).where("_ok").drop("_ok")


def restored(before: DataFrame, now: DataFrame, key: str, turns: str) -> DataFrame:
    """Undo: a record's restored turns stand before those added since."""
    b, n = before.select(key, F.col(turns).alias("_b")), now.select(key, F.col(turns).alias("_n"))
    empty = F.array().cast(before.schema[turns].dataType)
    return b.join(n, key, "full_outer").select(key, F.concat(F.coalesce("_b", empty), F.coalesce("_n", empty)).alias(turns))


# ---- conditional writes ------------------------------------------------------------------------------


@dataclass
class _CompareAndSet(Machine):
    """The digest of one record through its writes: [whether it is there, digest]."""

    columns = ("seq", "kind", "was", "expected", "made")
    out = "seq long, applied boolean, digest string"

    def start(self):
        return [None, None]

    def step(self, state, row):
        seq, kind, was, expected, made = row
        there, digest = state if state[0] is not None else [was is not None, was]
        applied = kind == "edit" or there and (kind == "delete" or digest == expected and made is not None)
        if applied:
            there, digest = (False, None) if kind == "delete" else (True, made)
        return [there, digest], [(seq, applied, digest)]


def conditional_merge(old: DataFrame, writes: DataFrame, key: str, digest: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(table, log): the table after all writes, and every write with applied and the digest it left.

    writes: (key, order, kind, expected, made) and the columns of old but digest.  An 'edit' always counts, also for a record that
    isn't there; a 'search' is a compare-and-set: it counts only if the record still has the digest that was searched, so an
    edit or a delete since then wins, and one without a result (made null) changes nothing; a 'delete' removes the record.
    Writes of a key count in order; keys are independent, and each is replayed without holding its writes.
    """
    log = writes.join(old.select(key, F.col(digest).alias("was")), key, "left")
    columns = log.select(key, F.col(order).alias("seq"), "kind", "was", "expected", "made")
    played = over_batch(columns, key, "seq", _CompareAndSet())
    log = writes.join(played.withColumnRenamed("seq", order), [key, order])
    last = log.where("applied").groupBy(key).agg(F.max_by(F.struct("kind", *[F.col("digest" if c == digest else c).alias(c) for c in old.columns if c != key]), order).alias("_w"))
    untouched = old.join(last.select(key), key, "left_anti")
    written = last.where("_w.kind <> 'delete'").select(*[key if c == key else F.col(f"_w.{c}").alias(c) for c in old.columns])
    return untouched.unionByName(written), log


def saved(old: DataFrame, new: DataFrame, dependents: DataFrame, key: str, digest: str, of: str) -> tuple[DataFrame, DataFrame]:
    """(table, dependents) after rows are saved: one comparison, two outputs.

    A saved row replaces that of its key; where its digest differs from the one before, the dependents of the key are
    deleted. A first save deletes none, and equal content keeps them.
    """
    both = old.select(key, F.col(digest).alias("_was")).join(new.select(key, F.col(digest).alias("_now")), key)
    changed = both.where(~F.col("_was").eqNullSafe(F.col("_now"))).select(F.col(key).alias(of))
    return upsert(old, new, [key], digest), dependents.join(changed, of, "left_anti")
