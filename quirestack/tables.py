"""Tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows that is handed to Python, about; a longer row stands alone.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; batches of rows that tasks hand to Python are bounded by BATCH_BYTES unless the session sets a bound of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by a key that few of them share, for work on rows that is dearer than to move them: a file may have few row groups, and each is one task."""
    return rows.repartition(key)
