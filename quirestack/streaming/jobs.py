"""Append-only logs as streams, and the same folds over batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import keyed

#: States that end a job.  The first of them counts; later ones change nothing.
TERMINAL = ("ready", "failed", "cancelled", "interrupted")


def read_log(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def counts(events: DataFrame, key: str, at: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by key and window, within a watermark; runs on streams and batches."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that is available now, as a table in memory; for tests and small results."""
    spark = stream.sparkSession
    running = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


def job_states(log: DataFrame, key: str = "job", state: str = "state", order: str = "seq", at: str = "at") -> DataFrame:
    """(key, state, finished_at): the first terminal state if there is one, else the latest; an aggregation, not a sort."""
    done = F.col(state).isin(*TERMINAL)
    folded = log.groupBy(key).agg(
        F.min(F.when(done, F.struct(F.col(order), F.col(state).alias("s"), F.col(at).alias("t")))).alias("end"), F.max_by(state, order).alias("last")
    )
    return folded.select(key, F.coalesce("end.s", "last").alias(state), F.col("end.t").alias("finished_at"))


def recovered(jobs: DataFrame, state: str = "state") -> DataFrame:
    """After a crash every unfinished job is interrupted."""
    return jobs.withColumn(state, F.when(F.col(state).isin(*TERMINAL), F.col(state)).otherwise("interrupted"))


def submissions(log: DataFrame, payload: list[str], order: str) -> DataFrame:
    """Idempotent submission: of equal payloads the first is kept."""
    w = Window.partitionBy(*payload).orderBy(order)
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def newly_finished(before: DataFrame, now: DataFrame, key: str, state: str) -> DataFrame:
    """Jobs that are ready now and weren't at the last look."""
    return now.where(F.col(state) == "ready").join(before.where(F.col(state) == "ready").select(key), key, "left_anti")


def event_line(line: Column) -> Column:
    """struct<data, done> of a line of a server's event stream, null for comments and other fields."""
    data = F.when(F.startswith(line, F.lit("data:")), F.ltrim(F.substring(line, 6, 1 << 30)))
    return F.when(data.isNotNull(), F.struct(F.when(data != "[DONE]", data).alias("data"), (data == "[DONE]").alias("done")))


def _released(parts: list[str], secret: str) -> list[str]:
    out, held = [], ""
    for part in parts:
        held = (held + part).replace(secret, "[REDACTED]")
        cut = max(0, len(held) - len(secret) + 1)
        out.append(held[:cut])
        held = held[cut:]
    return [*out[:-1], out[-1] + held] if out else []


def held_back(parts: DataFrame, key: str, order: str, part: str, secret: str) -> DataFrame:
    """(key, order, part): what may leave after each part of a stream, with a secret masked even where parts cut it.

    As many characters as the secret has, less one, wait for the next part; the last part lets all out.  A
    stream's parts are one answer, so they fit in one row.
    """
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(part).alias("p")))).alias("r"))
    run = F.pandas_udf(lambda x: pd.Series([_released(list(p), secret) for p in x], dtype=object), "array<string>")
    rows = rows.select(key, "r", run(F.transform("r", lambda x: x["p"])).alias("out"))
    return rows.select(key, F.explode(F.arrays_zip("r", "out")).alias("z")).select(key, F.col("z.r.o").alias(order), F.col("z.out").alias(part))


def cache_hits(calls: DataFrame, key: list[str], order: str, at: str, ttl: float, most: int = 100) -> DataFrame:
    """(key, order, at, hit): whether an entry of the key, filled by an earlier call, was younger than ttl; a call that misses fills it.

    Calls of a key stand by at and then order; each key is one entry of a cache of its own, whose state is all a task holds.
    """
    rows = calls.select(F.struct(*key).alias("g"), F.struct(F.col(at).cast("double").alias("t"), F.col(order).alias("o")).alias("call"), F.lit("").alias("entry"), F.col(at).cast("double").alias("at"), F.lit(True).alias("ok"))
    cache = keyed.Cache(ttl, most)
    cache.out = cache.out.replace("call long", f"call struct<t:double,o:{calls.schema[order].dataType.simpleString()}>")
    return keyed.over_batch(rows, "g", "call", cache).select("g.*", F.col("call.o").alias(order), F.col("call.t").alias(at), "hit")
