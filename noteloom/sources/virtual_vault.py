"""The collection of notes that a data folder stands for, derived from its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import text as tx


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each document: folder from source and language, title and path from the id."""
    d = read(spark, sf_dir, "documents")
    folder = F.concat_ws("/", "source", "lang")
    return d.select(
        "doc_id",
        F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("Note "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("body"),
        tx.content_hash(F.col("text")).alias("content_hash"),
        F.array("lang", "source").alias("tags"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note links the next one, and every seventh also a title that no note has."""
    n = notes(spark, sf_dir)
    after = F.concat(F.lit("Note "), (F.col("doc_id") + 1).cast("string"))
    lost = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Missing "), F.col("doc_id").cast("string")))
    return n.select(F.col("path").alias("source_path"), F.explode(F.array_compact(F.array(after, lost))).alias("target_title"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of model calls: a role, a time, tokens, and whether the cache was hit."""
    e = read(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("event_type").alias("role"), F.col("ts").cast("timestamp").alias("ts"), F.floor("value").cast("long").alias("tokens"), n.alias("k"))
