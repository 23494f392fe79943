"""Tables written once to the shared folder, for work that reads them several times or goes in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder, else, on one machine only, a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="quirestack-")
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: short lineage that outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
