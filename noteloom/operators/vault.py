"""Snapshots of the note index: what changed, upserts, deletes and their cascades.

Snapshots are tables; an operation takes the old table and gives the new one, so a lost
task is only run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sync_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, status``: added, updated, unchanged or removed, by path and content hash."""
    both = old.select("path", F.col("content_hash").alias("was")).join(
        new.select("path", F.col("content_hash").alias("now")), "path", "full_outer"
    )
    status = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when(F.col("was") == F.col("now"), "unchanged").otherwise("updated")
    )
    return both.select("path", status.alias("status"))


def sync_counts(status: DataFrame) -> DataFrame:
    seen = F.col("status")
    return status.agg(
        F.count_if(seen != "removed").alias("scanned"),
        F.count_if(seen.isin("added", "updated")).alias("updated"),
        F.count_if(seen == "unchanged").alias("unchanged"),
        F.count_if(seen == "removed").alias("removed"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str = "path", keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key, which hand on the ``keep`` columns."""
    o, n = old.alias("o"), new.alias("n")
    taken = F.col(f"n.{key}").isNotNull()
    columns = []
    for c in old.columns:
        value = F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        if c in keep or c == key:
            value = F.coalesce(f"o.{c}", f"n.{c}")
        columns.append(value.alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def replace_children(children: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All child rows of the keys in ``fresh`` are replaced by those of ``fresh``."""
    return children.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def without(table: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not a path in ``gone``. Links into a deleted note stay."""
    return table.join(gone.select(F.col("path").alias(column)).distinct(), column, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def folders(paths: DataFrame) -> DataFrame:
    """Folders that hold a note themselves; no ancestors."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return paths.where(F.col("path").contains("/")).select(folder.alias("folder")).distinct()


def tag_list(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).distinct()


#: The tables of an index, and the column that names a row's note.
CHILDREN = {"notes": "path", "tags": "path", "front": "path", "links": "source_path", "vectors": "path"}


def put_vectors(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """``path, model, vector`` with the vectors of ``fresh`` in place of those of their note and model.

    If ``fresh`` has several of one note and model, the one with the greatest ``ord`` counts.
    """
    last = latest(fresh, ["path", "model"], "ord").select("path", "model", "vector")
    return table.join(last.select("path", "model"), ["path", "model"], "left_anti").unionByName(last)


def vectors_of(table: DataFrame, model: str) -> DataFrame:
    """``path, vector`` of one model; vectors of different models are never compared."""
    return table.where(F.col("model") == model).select("path", "vector")


def vector_json(table: DataFrame) -> DataFrame:
    """Vectors as JSON texts, as they are exchanged with other stores; ``from_vector_json`` reads them."""
    return table.withColumn("vector_json", F.to_json("vector")).drop("vector")


def from_vector_json(rows: DataFrame) -> DataFrame:
    """Rows with their JSON vectors read; those that hold none are left out."""
    return rows.withColumn("vector", F.from_json("vector_json", "array<double>")).drop("vector_json").where("vector is not null and size(vector) > 0")


def synced(old: dict[str, DataFrame], new: dict[str, DataFrame], fresh_vectors: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The index after a pass over a collection, and its counts.

    Notes are told apart by hash. What hangs on a removed note goes with it in all tables; a changed or new
    note's tags, front matter and links are replaced by its own, and unchanged ones are not touched.
    Vectors stay until their note goes or ``fresh_vectors`` has one of the same model. Links that lead to a
    removed note stay with the notes that have them. ``created_at`` of a note is that of its first row.
    """
    status = sync_status(old["notes"], new["notes"])
    touched = status.where("status in ('added', 'updated', 'removed')").select("path")
    written = status.where("status in ('added', 'updated')").select("path")
    removed = status.where("status = 'removed'").select("path")
    out = {"notes": without(upsert(old["notes"], new["notes"].join(written, "path", "left_semi")), removed, "path")}
    for name in ("tags", "front", "links"):
        key = CHILDREN[name]
        own = written.withColumnRenamed("path", key)
        out[name] = without(old[name], touched, key).unionByName(new[name].join(own, key, "left_semi"))
    kept = without(old["vectors"], removed, "path")
    out["vectors"] = kept if fresh_vectors is None else put_vectors(kept, fresh_vectors.join(written, "path", "left_semi"))
    return out, sync_counts(status)
