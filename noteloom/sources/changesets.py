"""Staged changesets: a file for each task that machines read, and previews of its notes for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators.staging import DRAFT, completed
from noteloom.sources.files import read_inside, write_files
from noteloom.sources.notes import rendered

NAME = "changeset.json"
DRAFTS = (
    "array<struct<draft_id:string,ord:bigint,action:string,path:string,title:string,note_id:string,folder:string,frontmatter:string,body_md:string,append_section:string,tags:array<string>,"
    "links_out:array<string>,source_refs:array<string>,unverified_sections:array<string>,merged_from:array<string>,needs_review:boolean,critic_rounds:bigint,is_moc:boolean,source:string,created:string>>"
)
SCHEMA = f"task_id string, drafts {DRAFTS}, deletes array<string>, issues array<struct<seq:int,level:string,code:string,message:string,draft_id:string>>, ok boolean"


def changeset_files(drafts: DataFrame, deletes: DataFrame, issues: DataFrame) -> DataFrame:
    """``path, content`` of the files of every task in ``drafts``, ``deletes (task_id, path)`` or ``issues``.

    A preview is the section that an update appends, else the note as it will be; slashes of its path become ``__``.
    """
    rows = completed(drafts).withColumn("draft_id", F.col("draft_id").cast("string")).withColumn("ord", F.col("ord").cast("long"))
    task = F.col("task_id").cast("string").alias("task_id")
    own = rows.groupBy(task).agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in DRAFT if c not in ("task_id", "ord")]))).alias("drafts"))
    gone = deletes.groupBy(task).agg(F.array_sort(F.collect_set("path")).alias("deletes"))
    found = issues.groupBy(task).agg(F.array_sort(F.collect_list(F.struct("seq", "level", "code", "message", "draft_id"))).alias("issues"), (F.count_if(F.col("level") == "error") == 0).alias("ok"))
    whole = own.join(gone, "task_id", "full_outer").join(found, "task_id", "full_outer")
    filled = [F.coalesce(c, F.array().cast(dict(whole.dtypes)[c])).alias(c) for c in ("drafts", "deletes", "issues")]
    whole = whole.select("task_id", *filled, F.coalesce("ok", F.lit(True)).alias("ok"))
    folder = F.concat("task_id", F.lit("/"))
    text = whole.select(F.concat(folder, F.lit(NAME)).alias("path"), F.to_json(F.struct("task_id", "drafts", "deletes", "issues", "ok")).alias("content"))
    full = rendered(F.col("title"), F.col("tags"), F.col("created"), F.col("source"), F.col("body_md"), F.col("links_out"), F.col("is_moc"), F.col("source_refs"))
    more = F.coalesce("append_section", F.lit(""))
    shown = rows.select(
        F.concat(F.col("task_id").cast("string"), F.lit("/notes_preview/"), F.replace("path", F.lit("/"), F.lit("__"))).alias("path"), "ord", F.when(more != "", more).otherwise(full).alias("content")
    )
    previews = shown.groupBy("path").agg(F.max_by("content", "ord").alias("content"))  # of drafts of one path the last one is shown
    return text.unionByName(previews)


def save_changesets(folder: str, drafts: DataFrame, deletes: DataFrame, issues: DataFrame) -> None:
    """Write the files of all tasks at once; those of tasks saved before are replaced."""
    write_files(changeset_files(drafts, deletes, issues), folder, overwrite=True)


def load_changesets(spark: SparkSession, folder: str) -> DataFrame:
    """``SCHEMA`` of every task in ``folder``; files that can't be read as such are left out."""
    files = read_inside(spark, folder, NAME)
    parsed = files.select(F.from_json("content", SCHEMA + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("c"))
    return parsed.select("c.*").where("_corrupt_record is null and task_id is not null").drop("_corrupt_record")


def pending_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """``task_id`` of the folders that hold a changeset."""
    return read_inside(spark, folder, NAME).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("task_id"))
