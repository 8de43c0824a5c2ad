"""The link graph: resolution, both directions, redirects and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as tx


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links with ``target_path``: the note of exactly that title, the last in path order if several; else null."""
    by_title = notes.groupBy("title").agg(F.max("path").alias("target_path"))
    return links.join(by_title.withColumnRenamed("title", "target_title"), "target_title", "left")


def backlinks(resolved: DataFrame) -> DataFrame:
    """How many notes link each linked note."""
    pairs = resolved.where(F.col("target_path").isNotNull()).select("target_path", "source_path").distinct()
    return pairs.groupBy("target_path").agg(F.count("*").alias("n_sources"))


def names(notes: DataFrame, drafts: DataFrame) -> DataFrame:
    """Every name that a link may use: titles and file stems of notes and drafts."""
    all_ = notes.select("title", "path").unionByName(drafts.select("title", "path"))
    return all_.select(F.explode(F.array("title", tx.stem(F.col("path")))).alias("name")).distinct()


def check_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """``source_path, target_title, code`` of links that no known name has; dash variants are told apart."""
    exact = links.join(known.withColumnRenamed("name", "target_title"), "target_title", "left_anti")
    near = known.groupBy(tx.normalized_title(F.col("name")).alias("key")).agg(F.min("name").alias("near"))
    found = exact.withColumn("key", tx.normalized_title(F.col("target_title"))).join(near, "key", "left")
    code = F.when(F.col("near").isNotNull(), "wikilink_dash_variant_mismatch").otherwise("broken_wikilink")
    return found.select("source_path", "target_title", code.alias("code"))


def check_paths(drafts: DataFrame, notes: DataFrame) -> DataFrame:
    """``draft_id, code`` for creates that exist, updates that do not, and paths that repeat."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("draft_id"))
    seen = drafts.withColumn("place", place).join(notes.select("path", F.lit(True).alias("exists")).distinct(), "path", "left")
    exists = F.coalesce("exists", F.lit(False))
    codes = F.array_compact(
        F.array(
            F.when((F.col("action") == "create") & exists, "create_path_exists"),
            F.when((F.col("action") == "update") & ~exists, "update_path_missing"),
            F.when(F.col("place") > 1, "duplicate_path_in_batch"),
        )
    )
    return seen.select("draft_id", F.explode(codes).alias("code"))


def relationships(drafts: DataFrame) -> DataFrame:
    """Edges of drafts' links: to a path by title, else by file stem, else the title itself stays."""
    by_title = drafts.groupBy(F.col("title").alias("name")).agg(F.max_by("path", "draft_id").alias("by_title"))
    by_stem = drafts.groupBy(tx.stem(F.col("path")).alias("name")).agg(F.max_by("path", "draft_id").alias("by_stem"))
    edges = drafts.select(F.col("path").alias("from_note"), F.explode("links_out").alias("name"))
    found = edges.join(by_title, "name", "left").join(by_stem, "name", "left")
    return found.select("from_note", F.coalesce("by_title", "by_stem", "name").alias("to_note"))


def redirect(drafts: DataFrame, moved: DataFrame) -> DataFrame:
    """Drafts whose links to an ``old`` title go to its ``new`` one; own and repeated links go, order stays."""
    flat = drafts.select("draft_id", "title", F.posexplode_outer("links_out").alias("pos", "link"))
    target = moved.select(tx.normalized_title(F.col("old")).alias("key"), "new").dropDuplicates(["key"])
    joined = flat.withColumn("key", tx.normalized_title(F.col("link"))).join(target, "key", "left")
    sent = joined.withColumn("to", F.coalesce("new", "link"))
    kept = F.when(tx.normalized_title(F.col("to")) != tx.normalized_title(F.col("title")), F.struct("pos", "to"))
    lists = sent.groupBy("draft_id").agg(F.array_sort(F.collect_list(kept)).alias("l"))
    links = lists.select("draft_id", F.array_distinct(F.transform("l", lambda x: x["to"])).alias("links_out"))
    return drafts.drop("links_out").join(links, "draft_id")
