"""The corpus pipeline: quality filter, near-duplicate removal, pseudonyms, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirestack.llm import byte_bpe, jaccard_join, labelled, mixing, pii, quality
from quirestack.llm.common import documents, stored

#: Key of the pseudonyms; production jobs pass their own.
PII_KEY = pii.QUERY_KEY


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't reject; it is learned from the labelled rows among docs."""
    model = quality.train(docs, labelled.read_labels(spark, sf_dir, "quality"))
    return docs.where(quality.score(F.col("text"), model) >= quality.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, and the smallest of several rows of this id.

    Rows without an id are told apart by their texts, come after all ids, and stay if they hold no words.
    """
    by_text = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), by_text)))
    groups = jaccard_join.join(keyed, percent=80, width=5, key="_key").where("_key IS NOT NULL")
    several = groups.groupBy("_key").agg(F.max(F.col("_key") != F.col("component_id")).alias("_copy"), F.count(F.lit(1)).alias("_n")).where("_copy OR _n > 1")
    several = stored(several, "copies")
    alone = keyed.join(several.select("_key"), "_key", "left_anti").select(docs.columns)
    first = keyed.join(several.where("NOT _copy").select("_key"), "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return alone.unionByName(first.select("_row.*"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced within their formats; n_chars follows the new text."""
    found = pii.hidden(docs, PII_KEY, found="_found")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("_found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated by the fitted rates; targets are such that no domain shrinks, and each row stays at least once."""
    rates = mixing.mix_documents(docs, labelled.read_labels(spark, sf_dir, "quality"), keep_all=True)
    wanted = rates.groupBy("doc_id").agg(F.max("rate").alias("_rate")).where("_rate > 1")
    rows = docs.join(wanted, "doc_id", "left")
    times = F.greatest(F.lit(1), mixing.copies(F.coalesce("_rate", F.lit(1.0)), F.col("doc_id")))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, offsets and a check of the round trip for every row."""
    table = byte_bpe.token_table(docs, public_tokenizers.path(byte_bpe.VOCABULARY))
    return table.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL expresses none of the learned stages, so the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
