"""Cleaning a corpus: language, near duplicates, benchmark passages, secrets, packing.

Counted with the ``llm`` subpackage. Each stage takes ``(spark, docs, sf_dir)`` and works on
all that the stage before it kept; all but the last return the columns of ``documents``.
Between stages the documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import decontamination, jaccard_join, language_id, packing, queries, secret_scan
from noteloom.llm.tables import table
from noteloom.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LETTER = r"\p{L}"


def as_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the language found in place of the given one; null texts and texts without a letter go, no others.

    Packing keeps languages apart by it. Where no language is found, for want of any to learn from, the given one stays.
    """
    model = queries.op5_language_model(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs.where(F.col("text").rlike(LETTER)), model)
    return found.withColumn("lang", F.when(F.col("lang_pred") == "und", F.col("lang")).otherwise(F.col("lang_pred"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = 3, percent: int = 90) -> DataFrame:
    """Of each group of linked documents the one with the least id; rows without an id stay.

    Rows alike in id and text become one, also those without an id. Rows that share an id
    but not the text stay or go together, as one document.
    Documents link at ``percent`` of Jaccard over ``width``-word shingles. The pipeline takes
    ``NEAR``; the defaults are those of the op2 query.
    """
    groups = jaccard_join.jaccard_components(docs.select("doc_id", "text"), width=width, percent=percent)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")  # stays dealt by id, so repeats meet
    rows = [x.dropDuplicates(["doc_id", "text"]).select(*COLUMNS) for x in (named, docs.where("doc_id is null"))]
    return rows[0].unionByName(rows[1])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the passages of the benchmark cut out; those with no other word go."""
    found = decontamination.scan(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), remove=True)
    return as_documents(found.where("n_hit = 0 or n_hit < n_words"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the values of secrets replaced by a mark."""
    return as_documents(secret_scan.redact(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, in sequences of one language each; ``lang`` follows."""
    return packing.pack(docs, group_col="lang")


#: What counts as a near copy in the pipeline: five-word shingles, Jaccard of 0.8 or more.
NEAR = {"width": 5, "percent": 80}
STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", partial(near_duplicate_stage, **NEAR)),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]
#: SQL cannot express these stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; only what the last stage reads is left in the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    docs, earlier = table(spark, sf_dir, "documents"), None
    run_folder = f"{folder}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{run_folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if earlier:  # nothing reads it again
            place = spark._jvm.org.apache.hadoop.fs.Path(earlier)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        earlier = path
    return STAGES[-1][1](spark, docs, sf_dir)
