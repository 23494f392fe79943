"""The session this library is tuned for; on a cluster the submitted configuration wins."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quirestack", cpus: int = 8, shuffle: int | None = None, memory: str = "8g") -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle or cpus),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(name).master(f"local[{cpus}]")
    made = builder.config(map=conf).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made
