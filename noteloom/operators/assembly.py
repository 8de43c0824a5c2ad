"""Notes from sections, responses and merges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as tx

#: Fixed values.
PLACEHOLDER = "_Раздел не удалось сгенерировать автоматически — заполните его вручную._"
HUMANITIES = "> [!warning] Проверьте факты\n> Даты, цитаты и имена в этой заметке сгенерированы без источников — сверьте их перед использованием."
HUMANITIES_UPDATE = (
    "> [!warning] Проверьте факты\n> Даты, цитаты и имена в добавленных ниже разделах сгенерированы без источников — сверьте их перед использованием."
)


def first_responses(responses: DataFrame) -> DataFrame:
    """The first response of each batch and unit, by position."""
    place = F.row_number().over(Window.partitionBy("batch_id", "unit_index").orderBy("pos"))
    return responses.withColumn("place", place).where("place = 1").drop("place")


def with_responses(units: DataFrame, responses: DataFrame, default: Column) -> DataFrame:
    """Units with their payload; out-of-range responses drop out and missing ones take the default."""
    found = units.join(first_responses(responses), ["batch_id", "unit_index"], "left")
    return found.select("batch_id", "unit_index", F.coalesce("payload", default).alias("payload"), F.col("payload").isNull().alias("missing"))


def assigned_folders(notes: DataFrame, responses: DataFrame, valid: DataFrame, default: str) -> DataFrame:
    """A note's folder from its first response, if it is a valid one, else the default."""
    found = notes.join(first_responses(responses), ["batch_id", "unit_index"], "left")
    known = valid.select(F.col("folder").alias("payload"), F.lit(True).alias("known")).distinct()
    checked = found.join(known, "payload", "left")
    return checked.select("batch_id", "unit_index", F.when(F.col("known"), F.col("payload")).otherwise(default).alias("folder"))


def assembled(subpoints: DataFrame, sections: DataFrame) -> DataFrame:
    """``note_id, body, n_unverified``: a heading and its section for each subpoint, in order.

    The last section of a subpoint wins; a missing or blank one is a placeholder to check.
    """
    last = sections.groupBy("note_id", "ord").agg(F.max_by(F.struct("markdown", "needs_check"), "pos").alias("s"))
    joined = subpoints.join(last, ["note_id", "ord"], "left")
    text = tx.strip(F.coalesce("s.markdown", F.lit("")))
    check = F.coalesce("s.needs_check", F.lit(True))
    warn = tx.callout(F.lit("warning"), F.lit("Требует проверки"), F.lit("Детали этого раздела могут быть неточными."))
    body = F.when(text == "", PLACEHOLDER).otherwise(text)
    block = F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("heading")), F.when(check, warn), body)
    parts = joined.select("note_id", "ord", block.alias("block"), check.alias("check"))
    lists = parts.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("ord", "block"))).alias("b"), F.count_if("check").alias("n_unverified"))
    return lists.select("note_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("body"), "n_unverified")


def overview(drafts: DataFrame, taken: DataFrame, topic: str = "topic") -> DataFrame:
    """A map of content for each group with two or more creates: a free title and a list of the notes, those without a description as bare links."""
    creates = drafts.where("action = 'create'")
    described = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise("")
    lines = creates.select(topic, "ord", F.concat(F.lit("- [["), "title", F.lit("]]"), described).alias("line"))
    lists = lines.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"), F.count("*").alias("n_notes")).where("n_notes > 1")
    base = F.concat(F.col(topic), F.lit(" — обзор"))
    used = taken.select("title").distinct().withColumn("n", F.coalesce(F.regexp_extract("title", r" \((\d+)\)$", 1).try_cast("int"), F.lit(1)))
    used = used.withColumn("base", F.regexp_replace("title", r" \(\d+\)$", "")).groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("used"))
    joined = lists.withColumn("base", base).join(used, "base", "left")
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(F.coalesce("used", F.array())) + 1), F.coalesce("used", F.array().cast("array<int>"))))
    title = F.when(F.col("free") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("free").cast("string"), F.lit(")")))
    made = joined.withColumn("free", free)
    return made.select(topic, title.alias("title"), "n_notes", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def merged(drafts: DataFrame, group: str) -> DataFrame:
    """Drafts of a group as one, in order: sets keep their first occurrence, flags any, counts the most.

    Links between members go, as does a link of the group to its own title.
    """
    row = F.struct("ord", "title", "tags", "links_out", "body_md", "needs_review", "critic_rounds")
    lists = drafts.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("d"))
    flat = {c: F.array_distinct(F.flatten(F.transform("d", pick(c)))) for c in ("tags", "links_out")}
    titles = F.transform("d", lambda x: x["title"])
    out = lists.select(
        group, F.array_join(titles, " + ").alias("title"), titles.alias("merged_from"), flat["tags"].alias("tags"), flat["links_out"].alias("l"),
        F.array_join(F.transform("d", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), tx.closed_fence(tx.headings_within(x["body_md"], 1, 6, 1)))), "\n\n").alias("body_md"),
        F.exists("d", lambda x: x["needs_review"]).alias("needs_review"), F.array_max(F.transform("d", lambda x: x["critic_rounds"])).alias("critic_rounds"),
        F.array_min(F.transform("d", lambda x: x["ord"])).alias("ord"),
    )
    keys = F.transform(F.concat("merged_from", F.array("title")), tx.normalized_title)
    return out.withColumn("links_out", F.filter("l", lambda x: ~F.array_contains(keys, tx.normalized_title(x)))).drop("l")


def pick(name: str):
    return lambda x: x[name]


def renamed(frames: Iterator[pd.DataFrame], most: int = 99) -> Iterator[pd.DataFrame]:
    """New titles and paths for creates that collide; rows come sorted by task and order, with ``exists``."""
    task, seen, paths, titles = None, set(), set(), set()
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            if r.task_id != task:
                task, seen = r.task_id, set()
                paths, titles = set(r.taken_paths), set(r.taken_titles)
            title, path, fixed = r.title, r.path, False
            if r.action == "create":
                if r.exists or path in seen:
                    head = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
                    free = ((f"{title} ({n})", f"{head}{title} ({n}).md") for n in range(2, most + 1))
                    chosen = next(((t, p) for t, p in free if p not in paths and t not in titles), None)
                    if chosen:
                        title, path = chosen
                        fixed = True
                        titles.add(title)
                        paths.add(path)
                seen.add(path)
            out.append((r.task_id, r.draft_id, title, path, fixed))
        yield pd.DataFrame(out, columns=["task_id", "draft_id", "title", "path", "fixed"])


def autofixed(drafts: DataFrame, notes: DataFrame) -> DataFrame:
    """Drafts with free titles and paths; each task's drafts in order of ``ord``, one after the other.

    Only the vault's paths that begin like one of the task's own are looked up.
    """
    base = drafts.withColumn("base", F.regexp_replace("path", r"( \(\d+\))?\.md$", ""))
    near = notes.select("path", F.regexp_replace("path", r"( \(\d+\))?\.md$", "").alias("base"))
    close = base.select("task_id", "base").distinct().join(near, "base").groupBy("task_id").agg(F.collect_set("path").alias("near"))
    own = drafts.groupBy("task_id").agg(F.collect_set("path").alias("own"), F.collect_set("title").alias("taken_titles"))
    taken = own.join(close, "task_id", "left").select("task_id", "taken_titles", F.array_union("own", F.coalesce("near", F.array().cast("array<string>"))).alias("taken_paths"))
    there = notes.select("path", F.lit(True).alias("exists")).distinct()
    rows = drafts.join(there, "path", "left").join(taken, "task_id")
    rows = rows.select("task_id", "draft_id", "ord", "action", "title", "path", F.coalesce("exists", F.lit(False)).alias("exists"), "taken_paths", "taken_titles")
    ordered = rows.repartition("task_id").sortWithinPartitions("task_id", "ord")
    return ordered.mapInPandas(renamed, "task_id long, draft_id string, title string, path string, fixed boolean")
