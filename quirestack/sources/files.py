"""Files of records: JSON lines, source trees, feeds, versioned outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under a given schema; a line that doesn't parse comes back in _corrupt."""
    full = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{full}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_json(df: DataFrame, path: str) -> None:
    """Replaces a folder of records: written beside it first, then renamed, so a failed job leaves the old one."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    df.write.json(f"{path}.new")
    old, new, gone = (jvm.org.apache.hadoop.fs.Path(f"{path}{x}") for x in ("", ".new", ".old"))
    fs = old.getFileSystem(conf)
    if fs.exists(old) and not fs.rename(old, gone) or not fs.rename(new, old):
        raise OSError(f"{path} can't be replaced")
    fs.delete(gone, True)


def read_sources(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".tex", ".bib", ".bbl")) -> DataFrame:
    """(path, text, utf8) of source files; bytes that aren't UTF-8 are read as Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return kept.select("path", F.when(good, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"), good.alias("utf8"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds, white space collapsed."""
    schema = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    return rows.select(
        F.regexp_extract("id", r"([^/]+)$", 1).alias("id"), flat("title").alias("title"), flat("summary").alias("abstract"), "published", "updated",
        F.transform("author", lambda a: a["name"]).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("categories"),
    )


def stale_snapshots(names: DataFrame, name: str = "name", keep: int = 7) -> DataFrame:
    """Snapshots beyond the newest `keep` by name; names are distinct."""
    return names.join(names.orderBy(F.desc(name)).limit(keep).select(name), name, "left_anti")


def root_documents(files: DataFrame, group: str = "doc") -> DataFrame:
    """(group, path, tie): the file that includes others, lies highest and is longest; files: (group, path, text)."""
    scored = files.where(F.contains("text", F.lit("\\documentclass"))).withColumn(
        "score", F.struct(F.regexp_count("text", F.lit(r"\\(?:input|include)\b")).alias("i"), (-F.size(F.split("path", "/"))).alias("d"), F.length("text").alias("n"))
    )
    best = scored.groupBy(group).agg(F.max("score").alias("score"))
    top = scored.join(best, [group, "score"]).groupBy(group).agg(F.min("path").alias("path"), (F.count(F.lit(1)) > 1).alias("tie"))
    return top
