"""Committing a changeset to a collection of notes kept as versions of tables.

A version is a set of Parquet tables (``TABLES``) in a folder of its own. It counts once its manifest
stands in ``_manifests``, which is written last and never over another: readers take the highest
manifest, so a commit that fails or is refused is never seen, and of two that start
from one version only the first ends.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import text as tx
from noteloom.operators import links as lk
from noteloom.operators.staging import completed
from noteloom.sources.notes import parse_notes, rendered

TABLES = ("notes", "tags", "links", "front", "backups")


class CommitError(ValueError):
    pass


def conflicts(notes: DataFrame, drafts: DataFrame, deletes: DataFrame, allow_delete: bool = False) -> DataFrame:
    """``path, problem`` for whatever keeps a changeset from being applied."""
    by_path = drafts.groupBy("path").agg(F.count_if(F.col("action") == "create").alias("creates"), F.count_if(F.col("action") == "update").alias("updates"))
    seen = by_path.join(notes.select("path", F.lit(True).alias("exists")).distinct(), "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    rules = (
        ("create_collides_with_existing", (F.col("creates") > 0) & F.col("exists")),
        ("duplicate_path_in_changeset", F.col("creates") > 1),
        ("update_missing_target", (F.col("updates") > 0) & (F.col("creates") == 0) & ~F.col("exists")),
    )
    found = seen.select("path", F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))).alias("problem"))
    refused = deletes.select("path", F.lit("delete_not_allowed").alias("problem")).where(F.lit(not allow_delete))
    return found.unionByName(refused)


def applied(notes: DataFrame, drafts: DataFrame, deletes: DataFrame) -> DataFrame:
    """``path, content, before`` of every note after the changeset; ``before`` is null for those it doesn't update.

    New notes come first, then updates in order: one with a section appends it, one without
    writes the note anew. Deletes come last; that of a missing note does nothing.
    """
    rows = completed(drafts)
    full = rendered(F.col("title"), F.col("tags"), F.col("created"), F.col("source"), F.col("body_md"), F.col("links_out"), F.col("is_moc"), F.col("source_refs"))
    late = F.col("action") == "update"
    more = F.when(late & (F.coalesce("append_section", F.lit("")) != ""), tx.collapse_brackets(tx.strip(F.col("append_section"))))
    steps = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(late.alias("late"), "ord", more.alias("more"), F.when(more.isNull(), full).alias("full")))).alias("steps"))
    joined = notes.select("path", "content").join(steps, "path", "full_outer").join(deletes.select("path").distinct(), "path", "left_anti")

    def step(acc, x):
        ended = F.regexp_replace(F.coalesce(acc, F.lit("")), r"(?U)\s+$", "")
        return F.when(x["more"].isNotNull(), F.concat(ended, F.lit("\n\n"), x["more"], F.lit("\n"))).otherwise(x["full"])

    content = F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), F.col("content").cast("string"), step)
    return joined.select("path", content.alias("content"), F.when(F.col("steps").isNotNull(), F.col("content")).alias("before"), F.col("steps").isNotNull().alias("touched"))


def indexed(contents: DataFrame) -> dict[str, DataFrame]:
    """The tables of notes from their contents: what a sync keeps of them."""
    parsed = parse_notes(contents.select("path", F.col("content").alias("raw_content")))
    return {
        "notes": parsed.select("path", "title", F.col("raw_content").alias("content"), "content_hash", "summary"),
        "tags": parsed.select("path", F.explode("tags").alias("tag")),
        "links": parsed.select(F.col("path").alias("source_path"), F.explode("outlinks").alias("target_title")),
        "front": parsed.select("path", F.explode("frontmatter").alias("key", "value")),
    }


def _fs(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions with a manifest, ascending."""
    path, fs = _fs(spark, f"{root}/_manifests")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json")) if fs.exists(path) else []


def current(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the newest by default."""
    have = versions(spark, root)
    if not have:
        raise CommitError(f"no version in {root}")
    row = spark.read.json(f"{root}/_manifests/{have[-1] if version is None else version}.json").first()
    return {name: spark.read.parquet(f"{row.folder}/{name}") for name in TABLES}


def _publish(spark: SparkSession, root: str, version: int, tables: dict[str, DataFrame], info: dict) -> int:
    folder = f"{root}/v{version}-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}")
    path, fs = _fs(spark, f"{root}/_manifests/{version}.json")
    try:
        out = fs.create(path, False)
    except Exception as e:  # another commit was first
        raise CommitError(f"version {version} exists") from e
    out.write(bytearray(json.dumps({"version": version, "folder": folder, **info}).encode()))
    out.close()
    return version


def created(spark: SparkSession, root: str, contents: DataFrame) -> int:
    """The first version of a collection from ``contents (path, content)``."""
    tables = indexed(contents)
    tables["backups"] = contents.select("path", "content").limit(0)
    return _publish(spark, root, (versions(spark, root) or [0])[-1] + 1, tables, {})


def committed(spark: SparkSession, root: str, drafts: DataFrame, deletes: DataFrame, ok: bool, allow_delete: bool = False) -> int:
    """The version that a changeset makes of the newest one; refused as a whole if anything stands against it.

    Only notes that the changeset touches are parsed again; what is known of the others goes on.
    ``backups`` holds what updated notes were before.
    """
    if not ok:
        raise CommitError("the changeset hasn't passed validation")
    base = (versions(spark, root) or [0])[-1]
    old = current(spark, root)
    bad = conflicts(old["notes"], drafts, deletes, allow_delete).orderBy("problem", "path").limit(5).collect()
    if bad:
        raise CommitError("; ".join(f"{r.problem}: {r.path}" for r in bad))
    after = applied(old["notes"], drafts, deletes)
    touched = after.where("touched")
    fresh = indexed(touched.select("path", "content"))
    gone = touched.select("path").unionByName(deletes.select("path")).distinct()
    tables = {}
    for name, rows in fresh.items():
        key = "source_path" if name == "links" else "path"
        tables[name] = old[name].join(gone.withColumnRenamed("path", key), key, "left_anti").unionByName(rows)
    tables["backups"] = touched.where("before is not null").select("path", F.col("before").alias("content"))
    return _publish(spark, root, base + 1, tables, {"base": base})


def resolved_links(tables: dict[str, DataFrame]) -> DataFrame:
    """Links of a version with the paths they lead to."""
    return lk.resolve(tables["links"], tables["notes"])
