"""Markdown notes as a source and a sink, changesets and checkpoints as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import text as tx
from noteloom.functions import yaml as ym
from noteloom.operators.drafts import sources_block

FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """``path, raw_content`` of the Markdown files under ``root``, hidden folders left out.

    Spark's reader also leaves out files whose own name begins with ``.`` or ``_``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).makeQualified(
        spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).getUri(),
        spark._jvm.org.apache.hadoop.fs.Path("/"),
    )
    inner = F.substr("path", F.lit(len(base.toString().rstrip("/")) + 2))
    named = files.select(inner.alias("path"), F.decode("content", "utf-8").alias("raw_content"))
    return named.where(~F.col("path").rlike(r"(^|/)\.[^/]*/"))


def parse_notes(raw: DataFrame) -> DataFrame:
    """Title, front matter, body, tags, links, hash and summary of each note.

    ``front`` is the whole front matter as a VARIANT, ``frontmatter`` its keys with their values as
    text (lists and maps as JSON). Front matter that can't be read counts as none, but is not part of the body.
    """
    block = F.regexp_extract("raw_content", FRONT, 1)
    step = raw.withColumn("json", ym.as_json(F.when(block != "", block))).withColumn("body", F.regexp_replace("raw_content", FRONT, ""))
    step = step.withColumn("json", F.when(F.col("json").startswith("{"), F.col("json")))
    front = F.parse_json("json")
    given = F.coalesce(F.try_variant_get(front, "$.tags", "array<string>"), F.array(F.try_variant_get(front, "$.tags", "string")))
    own = F.filter(F.coalesce(given, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    title = F.try_variant_get(front, "$.title", "string")
    return step.select(
        "path", F.when(title != "", title).otherwise(tx.stem(F.col("path"))).alias("title"), front.alias("front"),
        F.coalesce(F.from_json("json", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("frontmatter"), "body", "raw_content",
        tx.all_tags(own, F.col("body")).alias("tags"), tx.wikilinks(F.col("body")).alias("outlinks"),
        tx.content_hash(F.col("raw_content")).alias("content_hash"), tx.summary(F.col("body")).alias("summary"),
    )


def scalar(text):
    """A text as a YAML scalar: as it is where it reads back as that text, else in double quotes."""
    plain = text.rlike(r"^[A-Za-zА-Яа-яЁё_](?:[\wА-Яа-яЁё ./()+,'!?«»—–…-]*[\wА-Яа-яЁё./()+'!?«»…-])?$") & ~text.rlike(r"(?i)^(?:true|false|yes|no|on|off|null)$")
    packed = F.to_json(F.struct(text.alias("t")))
    return F.when(plain, text).otherwise(F.substr(packed, F.lit(6), F.length(packed) - 6))


def rendered(title, tags, created, source, body, links, is_moc, refs=None):
    """A note's file: front matter in fixed order without empty values, sources, body, related links unless a map."""
    head = F.array_compact(
        F.array(
            F.when(title != "", F.concat(F.lit("title: "), scalar(title))),
            F.when(F.size(tags) > 0, F.concat(F.lit("tags:\n- "), F.array_join(F.transform(tags, scalar), "\n- "))),
            F.when(created != "", F.concat(F.lit("created: '"), created, F.lit("'"))),
            F.when(source != "", F.concat(F.lit("source: "), scalar(source))),
        )
    )
    related = F.array_join(F.transform(links, lambda x: F.concat(F.lit("- [["), tx.strip_brackets(x), F.lit("]]"))), "\n")
    tail = F.when((F.size(links) > 0) & ~is_moc, F.concat(F.lit("\n\n## Связанные заметки\n\n"), related)).otherwise("")
    origin = F.lit("") if refs is None else sources_block(refs)
    return F.concat(F.lit("---\n"), F.array_join(head, "\n"), F.lit("\n---\n\n"), origin, tx.collapse_brackets(tx.strip(body)), tail, F.lit("\n"))


def write_json(df: DataFrame, path: str) -> None:
    """A changeset or checkpoint table; the commit protocol makes a whole folder appear at once."""
    df.write.mode("errorifexists").json(path)


def read_checkpoints(spark: SparkSession, path: str, schema: str, version: int = 5) -> DataFrame:
    """Checkpoint rows of the wanted version; broken rows and other versions are left out."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & (F.col("version") == version)).drop("_corrupt_record")
