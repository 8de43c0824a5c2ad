"""A task's changeset: path conflicts mended, drafts merged, checked in a fixed order and described.

Drafts are rows ``task_id, draft_id, ord, action, path, title`` and any of ``DEFAULTS``; ``ord`` is
a draft's place in its task. Issues are rows ``ISSUE``: the five keys behind the task put those of
unlike checks in one order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import markdown as md
from noteloom.functions import text as tx
from noteloom.operators import drafts as dr
from noteloom.operators.assembly import HUMANITIES, PLACEHOLDER
from noteloom.operators.validation import letter_counts
from noteloom.session import cut

STRINGS = "array<string>"
#: Columns that a draft may lack, with their types and, in SQL, the values then.
DEFAULTS = {
    "note_id": ("string", "''"), "folder": ("string", "''"), "frontmatter": ("string", "'{}'"), "body_md": ("string", "''"), "append_section": ("string", "null"),
    "tags": (STRINGS, "array()"), "links_out": (STRINGS, "array()"), "source_refs": (STRINGS, "array()"), "unverified_sections": (STRINGS, "array()"),
    "merged_from": (STRINGS, "array()"), "needs_review": ("boolean", "false"), "critic_rounds": ("long", "0"), "is_moc": ("boolean", "false"),
    "source": ("string", "''"), "created": ("string", "''"),
}
DRAFT = ["task_id", "draft_id", "ord", "action", "path", "title", *DEFAULTS]
ISSUE = ["task_id", "phase", "late", "ord", "part", "pos", "level", "code", "message", "draft_id"]
MOST_SUFFIX = 99
SUFFIX = r"\s*\(\d+\)$"

#: Codes and wording of the issues, in the form that readers of reports know.
MESSAGES = {
    "delete_not_allowed": ("error", "Changeset содержит {0} операций удаления, но ALLOW_DELETE=false. Удаление заблокировано по умолчанию."),
    "create_collides_with_existing": ("error", "action=create, но файл уже существует в Vault: {0}. Должно было быть action=update."),
    "update_missing_target": ("error", "action=update ссылается на несуществующий файл: {0}"),
    "duplicate_path_in_changeset": ("error", "Два черновика в одном changeset нацелены на один и тот же путь: {0}"),
    "wikilink_dash_variant_mismatch": ("warning", "Заметка '{0}' ссылается на '{1}', что почти совпадает с существующей '{2}' (отличаются только Unicode-варианты дефиса). Проверьте вручную."),
    "broken_wikilink": ("warning", "Заметка '{0}' ссылается на несуществующую заметку '{1}' (будет создана 'красная' ссылка в Obsidian)"),
    "yaml_unsupported_type": ("error", "Frontmatter key '{0}' {1}: {2}"),
    "empty_title": ("error", "Пустой заголовок заметки"),
    "empty_body": ("error", "Тело заметки пустое (и append_section тоже пуст)"),
    "unbalanced_code_fence": ("error", "Незакрытый блок кода (нечётное число строк-ограждений ```)"),
    "very_short_note": ("warning", "Очень короткая заметка (<40 символов) — возможно, стоит объединить с другой"),
    "note_too_short_structural": ("warning", "Новая заметка содержит только {0} содержательных блок(-а/-ов) (абзац, список, код, таблица; callout'ы не считаются) — рекомендуемый минимум 3. Проверьте, не пропущены ли разделы."),
    "note_language_mismatch": ("warning", "Доля кириллицы в тексте заметки всего {0}% — возможно, модель написала заметку не на русском. Проверьте перед approve."),
    "missing_outline_heading": ("warning", "Заголовок «{0}» из плана отсутствует в тексте заметки «{1}»"),
    "path_autofixed": ("warning", "Заметка «{0}»: {1} ({2}) — переименована в «{3}» ({4})."),
}
TAKEN, REPEATED = "файл уже существует в Vault", "путь занят другой заметкой этой задачи"
IN_LIST, WHOLE = "содержит неподдерживаемый тип в списке", "имеет неподдерживаемый тип"


def completed(drafts: DataFrame) -> DataFrame:
    """Drafts with all columns of ``DRAFT``; nulls in columns with a value of their own take it."""
    columns = []
    for name, (kind, value) in DEFAULTS.items():
        value = F.expr(value).cast(kind)
        columns.append((F.coalesce(F.col(name).cast(kind), value) if name in drafts.columns else value).alias(name))
    return drafts.select(*DRAFT[:6], *columns)


def message(code: str, *values: Column) -> Column:
    """The wording of a code with its places filled."""
    parts, rest = [], MESSAGES[code][1]
    for k, value in enumerate(values):
        head, rest = rest.split("{%d}" % k, 1)
        parts += [F.lit(head), value.cast("string")]
    return F.concat(*parts, F.lit(rest))


def issue(code: str, phase: int, part: int, pos: Column, text: Column, late: Column | None = None, ord_: Column | None = None, draft_id: Column | None = None) -> list[Column]:
    """The columns of an issue behind its task."""
    late = (F.col("action") == "update").cast("int") if late is None else late
    own = F.col("draft_id").cast("string") if draft_id is None else draft_id
    place = F.col("ord") if ord_ is None else ord_
    return [
        F.lit(phase).alias("phase"), late.alias("late"), place.cast("long").alias("ord"), F.lit(part).alias("part"), pos.cast("long").alias("pos"),
        F.lit(MESSAGES[code][0]).alias("level"), F.lit(code).alias("code"), text.alias("message"), own.alias("draft_id"),
    ]


# --- paths -------------------------------------------------------------------------------------


def base_of(name: Column) -> Column:
    """What names have in common that differ by a number in brackets."""
    return F.regexp_replace(name, SUFFIX, "")


def suffixed(frames: Iterator[pd.DataFrame], most: int = MOST_SUFFIX) -> Iterator[pd.DataFrame]:
    """Numbers for conflicting drafts; a group's taken names come first, then its drafts in order.

    A group holds what shares task and base of name, and only drafts that conflict.
    """
    group, paths, titles = None, set(), set()
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            if (r.task_id, r.base) != group:
                group, paths, titles = (r.task_id, r.base), set(), set()
            if pd.isna(r.draft_id):
                (titles if r.is_title else paths).add(r.name)
                continue
            for n in range(2, most + 1):
                title, path = f"{r.name} ({n})", f"{r.stem}({n}).md"
                if path not in paths and title not in titles:
                    titles.add(title)
                    paths.add(path)
                    out.append((r.task_id, r.draft_id, n, title, path))
                    break
        yield pd.DataFrame(out, columns=["task_id", "draft_id", "number", "new_title", "new_path"])


def renames(drafts: DataFrame, notes: DataFrame) -> DataFrame:
    """``task_id, draft_id, ord, title, path, exists, new_title, new_path`` of new drafts whose path is taken.

    Taken is a path of a note, or of an earlier new draft of the task that keeps it. A draft gets the
    first free number from 2 to 99, if there is one; earlier drafts of the task choose first.
    """
    there = notes.select("path", F.lit(True).alias("exists")).distinct()
    place = F.row_number().over(Window.partitionBy("task_id", "path").orderBy("ord"))
    new = drafts.where("action = 'create'").select("task_id", "draft_id", "ord", "title", "path").withColumn("place", place)
    marked = new.join(there, "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False))).where("exists or place > 1")
    folder = F.when(F.col("path").contains("/"), F.concat(F.regexp_extract("path", "^(.*)/", 1), F.lit("/"))).otherwise("")
    base = F.regexp_replace(tx.slug(F.concat("title", F.lit(" (2)"))), r"\s*\(2\)$", "")
    stem = F.concat(F.regexp_replace(folder, "^/+|/+(?=/$)", ""), F.when(base != "", F.concat(base, F.lit(" "))).otherwise(""))
    bad = marked.withColumn("base", base).withColumn("stem", stem)
    bases = bad.select("task_id", "base").distinct()
    own = drafts.select("task_id", base_of(tx.slug(F.col("title"))).alias("base"), F.col("title").alias("name"), F.lit(True).alias("is_title"))
    stem = base_of(tx.stem(F.col("path"))).alias("base")
    own = own.unionByName(drafts.select("task_id", stem, F.col("path").alias("name"), F.lit(False).alias("is_title"))).join(bases, ["task_id", "base"], "left_semi")
    near = notes.select(stem, F.col("path").alias("name")).join(bases, "base").select("task_id", "base", "name", F.lit(False).alias("is_title"))
    taken = own.unionByName(near).distinct().select("task_id", "base", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("draft_id"), "name", "is_title", F.lit("").alias("stem"))
    asked = bad.select("task_id", "base", F.col("ord").cast("long"), F.col("draft_id").cast("string"), F.col("title").alias("name"), F.lit(False).alias("is_title"), "stem")
    kind = drafts.schema["task_id"].dataType.simpleString()
    rows = taken.unionByName(asked).repartition("task_id", "base").sortWithinPartitions("task_id", "base", F.asc_nulls_first("ord"))
    found = rows.drop("ord").mapInPandas(suffixed, f"task_id {kind}, draft_id string, number int, new_title string, new_path string")
    return bad.withColumn("draft_id", F.col("draft_id").cast("string")).join(found, ["task_id", "draft_id"]).select(
        "task_id", "draft_id", "ord", "title", "path", "exists", "new_title", "new_path"
    )


def redirected(drafts: DataFrame, moved: DataFrame) -> DataFrame:
    """Drafts whose links to a ``key`` (a normalized title) of their task go to its ``new`` title.

    Links to the draft itself and repeats go, order stays; tasks that move nothing keep their links as they are.
    """
    rows = drafts.withColumn("draft_id", F.col("draft_id").cast("string"))
    flat = rows.join(moved.select("task_id").distinct(), "task_id", "left_semi").select("task_id", "draft_id", "title", F.posexplode_outer("links_out").alias("pos", "link"))
    sent = flat.withColumn("key", tx.normalized_title(F.col("link"))).join(moved, ["task_id", "key"], "left").withColumn("to", F.coalesce("new", "link"))
    kept = F.when(tx.normalized_title(F.col("to")) != tx.normalized_title(F.col("title")), F.struct("pos", "to"))
    lists = sent.groupBy("task_id", "draft_id").agg(F.array_sort(F.collect_list(kept)).alias("l"))
    after = lists.select("task_id", "draft_id", F.array_distinct(F.transform("l", lambda x: x["to"])).alias("after"))
    return rows.join(after, ["task_id", "draft_id"], "left").withColumn("links_out", F.coalesce("after", "links_out")).drop("after")


def autofixed(drafts: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts with free paths, and an issue for each that was renamed.

    Where a note has the path, links of the task to the draft's old title go to the new one; if
    several such drafts share a title, to that of the first. A draft without a free number stays.
    """
    rows = drafts.withColumn("draft_id", F.col("draft_id").cast("string"))
    new = renames(drafts, notes)
    fixed = rows.join(new.select("task_id", "draft_id", "new_title", "new_path"), ["task_id", "draft_id"], "left")
    fixed = fixed.withColumn("title", F.coalesce("new_title", "title")).withColumn("path", F.coalesce("new_path", "path")).drop("new_title", "new_path")
    moved = new.where("exists").groupBy("task_id", tx.normalized_title(F.col("title")).alias("key")).agg(F.min_by("new_title", "ord").alias("new"))
    reason = F.when(F.col("exists"), TAKEN).otherwise(REPEATED)
    text = message("path_autofixed", F.col("title"), reason, F.col("path"), F.col("new_title"), F.col("new_path"))
    return redirected(fixed, moved), new.select("task_id", *issue("path_autofixed", 0, 0, F.lit(0), text, late=F.lit(0)))


# --- merging -----------------------------------------------------------------------------------


def merge_problems(drafts: DataFrame, groups: DataFrame) -> DataFrame:
    """``task_id, g, problem`` for groups that can't be merged: too few, not new, unknown or in two groups."""
    named = groups.select("task_id", "g", F.col("draft_id").cast("string").alias("draft_id"))
    known = drafts.select("task_id", F.col("draft_id").cast("string").alias("draft_id"), "action")
    rows = named.distinct().join(known, ["task_id", "draft_id"], "left")
    own = rows.groupBy("task_id", "g").agg(
        F.count("*").alias("n"), F.bool_or(F.col("action").isNull()).alias("unknown"), F.bool_or(F.col("action") != "create").alias("other")
    )
    problem = F.when(F.col("unknown"), "unknown_draft").when(F.col("other"), "not_a_create").when(F.col("n") < 2, "fewer_than_two")
    several = named.groupBy("task_id", "draft_id").agg(F.collect_set("g").alias("gs"), F.count("*").alias("n")).where("size(gs) > 1")
    overlaps = several.select("task_id", F.explode("gs").alias("g"), F.lit("overlap").alias("problem")).distinct()
    return own.select("task_id", "g", problem.alias("problem")).where("problem is not null").unionByName(overlaps)


def merged(drafts: DataFrame, groups: DataFrame, check: bool = True) -> DataFrame:
    """Drafts in which each group ``task_id, g, draft_id`` and maybe ``title`` has become one, in its first one's place.

    Bodies stand under their titles, one level deeper, open code blocks closed; the warning to check
    facts is hoisted once. Sets keep their first occurrences, flags are any, rounds the most;
    links within the group go, and links of other drafts of the task go to the merged one.
    Groups with a problem are refused.
    """
    if check and (bad := merge_problems(drafts, groups).orderBy("task_id", "g", "problem").first()):
        raise ValueError(f"group {bad.g} of task {bad.task_id}: {bad.problem}")
    rows = completed(drafts).withColumn("draft_id", F.col("draft_id").cast("string"))
    given = F.max("title") if "title" in groups.columns else F.lit(None).cast("string")
    titles = groups.groupBy("task_id", "g").agg(given.alias("own_title"))
    members = groups.select("task_id", "g", F.col("draft_id").cast("string").alias("draft_id")).distinct()
    lists = rows.join(members, ["task_id", "draft_id"]).groupBy("task_id", "g").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in DRAFT if c not in ("task_id", "ord")]))).alias("d"))
    of = lambda name: F.transform("d", lambda x: x[name])
    first = lambda name: F.get("d", F.lit(0))[name]
    lists = lists.join(titles, ["task_id", "g"])
    title = F.when(tx.strip(F.coalesce("own_title", F.lit(""))) != "", tx.strip(F.col("own_title"))).otherwise(F.array_join(of("title"), " + "))
    lists = lists.withColumn("title", title)
    inner = F.transform(F.concat(of("title"), F.array("title")), tx.normalized_title)

    def section(x: Column) -> Column:
        body = tx.strip(x["body_md"])
        rest = F.when(body.startswith(HUMANITIES), F.regexp_replace(F.substr(body, F.lit(len(HUMANITIES) + 1)), r"^\n+", "")).otherwise(body)
        return F.concat(F.lit("## "), x["title"], F.lit("\n\n"), tx.headings_within(tx.closed_fence(rest), 1, 6, 1))

    warn = F.exists("d", lambda x: tx.strip(x["body_md"]).startswith(HUMANITIES))
    body = F.concat(F.when(warn, HUMANITIES + "\n\n").otherwise(""), F.array_join(F.transform("d", section), "\n\n"))
    froms = F.flatten(F.transform("d", lambda x: F.when(F.size(x["merged_from"]) > 0, x["merged_from"]).otherwise(F.array(x["title"]))))
    sets = {c: F.array_distinct(F.flatten(of(c))) for c in ("tags", "source_refs", "unverified_sections")}
    links = F.filter(F.array_distinct(F.flatten(of("links_out"))), lambda x: ~F.array_contains(inner, tx.normalized_title(x)))
    one = lists.select(
        "task_id", first("draft_id").alias("draft_id"), first("ord").alias("ord"), F.lit("create").alias("action"),
        tx.note_path(first("folder"), F.col("title")).alias("path"), "title", F.lit("").alias("note_id"), first("folder").alias("folder"), first("frontmatter").alias("frontmatter"),
        body.alias("body_md"), F.lit(None).cast("string").alias("append_section"), sets["tags"].alias("tags"), links.alias("links_out"),
        sets["source_refs"].alias("source_refs"), sets["unverified_sections"].alias("unverified_sections"), froms.alias("merged_from"),
        F.exists("d", lambda x: x["needs_review"]).alias("needs_review"), F.array_max(of("critic_rounds")).alias("critic_rounds"),
        F.lit(False).alias("is_moc"), first("source").alias("source"), first("created").alias("created"),
    )
    alone = rows.join(members, ["task_id", "draft_id"], "left_anti")
    after = alone.unionByName(one)
    moved = after.select("task_id", F.col("ord").alias("o"), F.explode("merged_from").alias("old"), F.col("title").alias("new"))
    moved = moved.groupBy("task_id", tx.normalized_title(F.col("old")).alias("key")).agg(F.max_by("new", "o").alias("new"))
    return redirected(after, moved).select(DRAFT)


def all_creates(drafts: DataFrame) -> DataFrame:
    """The groups that merge all new drafts of each task with two or more."""
    new = drafts.where("action = 'create'")
    many = new.groupBy("task_id").agg(F.count("*").alias("n")).where("n > 1")
    return new.join(many, "task_id", "left_semi").select("task_id", F.lit(0).alias("g"), "draft_id")


# --- maps and links ----------------------------------------------------------------------------


def content_map(drafts: DataFrame, topics: DataFrame, abstracts: DataFrame, notes: DataFrame) -> DataFrame:
    """A map of content for each task with two or more new drafts, as a draft.

    ``topics`` has ``task_id, topic, summary, folder, domain``, ``abstracts`` ``note_id, abstract``. The list has each
    draft's abstract or first sentence, and only its link where there is neither. Title and path
    take the first number that neither the task nor the vault has.
    """
    rows = completed(drafts).where("action = 'create' and not is_moc").join(abstracts.where("note_id <> ''").select("note_id", "abstract"), "note_id", "left")
    said = F.coalesce(dr.overview_description(F.col("abstract"), F.col("body_md")), F.lit(""))
    line = F.concat(F.lit("- [["), "title", F.lit("]]"), F.when(said != "", F.concat(F.lit(" — "), said)).otherwise(""))
    lists = rows.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", line.alias("line")))).alias("l")).where("size(l) > 1")
    made = lists.join(topics, "task_id").withColumn("base", F.concat(tx.strip(F.col("topic")), F.lit(" — обзор")))
    number = lambda name: F.coalesce(F.regexp_extract(name, r" \((\d+)\)$", 1).try_cast("int"), F.lit(1))
    own_title = drafts.select("task_id", F.regexp_replace("title", r" \(\d+\)$", "").alias("base"), number(F.col("title")).alias("n"))
    # paths are compared through the name that a title with the number gives a file
    path_base = lambda path: F.regexp_replace(F.regexp_replace(path, r"\.md$", ""), r" \(\d+\)$", "")
    path_number = lambda path: number(F.regexp_replace(path, r"\.md$", ""))
    wanted = made.select("task_id", path_base(tx.note_path(F.col("folder"), F.col("base"))).alias("path_base"), "base")
    by_path = drafts.select("task_id", path_base(F.col("path")).alias("path_base"), path_number(F.col("path")).alias("n")).join(wanted, ["task_id", "path_base"])
    in_vault = notes.select(path_base(F.col("path")).alias("path_base"), path_number(F.col("path")).alias("n")).join(wanted, "path_base")
    used = reduce(DataFrame.unionByName, [own_title, *[x.select("task_id", "base", "n") for x in (by_path, in_vault)]])
    used = used.groupBy("task_id", "base").agg(F.collect_set("n").alias("used"))
    made = made.join(used, ["task_id", "base"], "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    made = made.withColumn("free", F.array_min(F.array_except(F.sequence(F.lit(1), F.size("used") + 1), F.col("used"))))
    title = F.when(F.col("free") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("free").cast("string"), F.lit(")")))
    summary = tx.strip(F.coalesce("summary", F.lit("")))
    brief = F.when(summary != "", F.concat(tx.callout(F.lit("abstract"), F.lit("Кратко"), summary), F.lit("\n\n"))).otherwise("")
    body = F.concat(brief, F.lit("## Заметки\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    last = drafts.groupBy("task_id").agg((F.max("ord") + 1).alias("next"))
    out = made.join(last, "task_id").select(
        "task_id", F.concat(F.lit("moc-"), F.col("task_id").cast("string")).alias("draft_id"), F.col("next").alias("ord"), F.lit("create").alias("action"),
        tx.note_path(F.col("folder"), title).alias("path"), title.alias("title"), "folder", body.alias("body_md"),
        tx.add_domain_tag(F.array(F.lit("moc")), F.col("domain")).alias("tags"), F.transform("l", lambda x: x["title"]).alias("links_out"), F.lit(True).alias("is_moc"),
    )
    return completed(out)


def inline_linked(drafts: DataFrame) -> DataFrame:
    """Drafts whose links stand where their bodies first name them; updates, maps and a draft's own title stay out."""
    own = tx.normalized_title(F.col("title"))
    targets = F.filter("links_out", lambda x: tx.normalized_title(x) != own)
    fits = (F.col("action") == "create") & ~F.col("is_moc") & (F.size("links_out") > 0) & (F.col("body_md") != "")
    body = md.linked(F.when(fits, F.col("body_md")), targets)
    return drafts.withColumn("body_md", F.coalesce(F.when(fits, body), "body_md"))


# --- validation --------------------------------------------------------------------------------


def delete_issues(deletes: DataFrame, allowed: bool) -> DataFrame:
    counts = deletes.groupBy("task_id").agg(F.count("*").alias("n")).where(F.lit(not allowed))
    nothing = F.lit(None).cast("string")
    return counts.select("task_id", *issue("delete_not_allowed", 1, 0, F.lit(0), message("delete_not_allowed", F.col("n")), F.lit(0), F.lit(0), nothing))


def path_issues(drafts: DataFrame, notes: DataFrame) -> DataFrame:
    late = F.col("action") == "update"
    place = F.row_number().over(Window.partitionBy("task_id", "path").orderBy(late, "ord"))
    seen = drafts.withColumn("place", place).join(notes.select("path", F.lit(True).alias("exists")).distinct(), "path", "left")
    there = F.coalesce("exists", F.lit(False))
    rules = (("create_collides_with_existing", (F.col("action") == "create") & there), ("update_missing_target", late & ~there), ("duplicate_path_in_changeset", F.col("place") > 1))
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(k).alias("pos"), F.lit(code).alias("code"), message(code, F.col("path")).alias("message"))) for k, (code, test) in enumerate(rules)]))
    return seen.withColumn("i", F.explode(found)).select(
        "task_id", F.lit(2).alias("phase"), late.cast("int").alias("late"), F.col("ord").cast("long").alias("ord"), F.lit(0).alias("part"), F.col("i.pos").cast("long").alias("pos"),
        F.lit("error").alias("level"), "i.code", "i.message", F.col("draft_id").cast("string").alias("draft_id"),
    )


def link_issues(drafts: DataFrame, notes: DataFrame) -> DataFrame:
    """Links that no title or file name of the vault or of the task's drafts has."""
    both = lambda df, *more: df.select(*more, F.explode(F.array("title", tx.stem(F.col("path")))).alias("name")).distinct()
    vault, own = both(notes), both(drafts, "task_id")
    flat = drafts.select("task_id", "draft_id", "ord", "action", "title", F.posexplode("links_out").alias("at", "name"))
    lost = flat.join(vault, "name", "left_anti").join(own, ["task_id", "name"], "left_anti").withColumn("key", tx.normalized_title(F.col("name")))
    near = lambda df, *more: df.groupBy(*more, tx.normalized_title(F.col("name")).alias("key")).agg(F.min("name").alias("near"))
    found = lost.join(near(vault).withColumnRenamed("near", "near_note"), "key", "left").join(near(own, "task_id").withColumnRenamed("near", "near_draft"), ["task_id", "key"], "left")
    found = found.withColumn("near", F.least("near_note", "near_draft"))
    dash = found.where("near is not null").select("task_id", *issue("wikilink_dash_variant_mismatch", 3, 0, F.col("at"), message("wikilink_dash_variant_mismatch", F.col("title"), F.col("name"), F.col("near"))))
    return dash.unionByName(found.where("near is null").select("task_id", *issue("broken_wikilink", 3, 0, F.col("at"), message("broken_wikilink", F.col("title"), F.col("name")))))


def front_issues(drafts: DataFrame) -> DataFrame:
    """Values of the front matter, a JSON object, that are neither scalars nor lists of them, and blank titles."""
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    name = lambda k: F.when(k == "OBJECT", "<class 'dict'>").when(k == "ARRAY", "<class 'list'>")
    pairs = F.map_entries(F.from_json("frontmatter", "map<string,variant>"))
    flat = drafts.select("task_id", "draft_id", "ord", "action", F.posexplode(pairs).alias("at", "e")).select("*", F.col("e.key").alias("key"), F.col("e.value").alias("value")).drop("e")
    flat = flat.withColumn("kind", kind(F.col("value")))
    inner = flat.where("kind = 'ARRAY'").select("*", F.posexplode(F.col("value").cast("array<variant>")).alias("k", "x")).withColumn("inner", kind(F.col("x")))
    pos = F.col("at") * (1 << 32)
    whole = flat.where("kind = 'OBJECT'").select("task_id", *issue("yaml_unsupported_type", 4, 0, pos, message("yaml_unsupported_type", F.col("key"), F.lit(WHOLE), name(F.col("kind")))))
    listed = inner.where("inner in ('OBJECT', 'ARRAY')").select("task_id", *issue("yaml_unsupported_type", 4, 0, pos + F.col("k"), message("yaml_unsupported_type", F.col("key"), F.lit(IN_LIST), name(F.col("inner")))))
    blank = drafts.where(tx.strip(F.col("title")) == "").select("task_id", *issue("empty_title", 4, 0, F.lit(1 << 62), message("empty_title")))
    return whole.unionByName(listed).unionByName(blank)


def body_issues(drafts: DataFrame) -> DataFrame:
    body, more = F.col("body_md"), F.coalesce("append_section", F.lit(""))
    text = F.when(body != "", body).otherwise(more)
    empty = (tx.strip(body) == "") & (more == "")
    texts = drafts.select("task_id", "draft_id", "ord", "action", "is_moc", empty.alias("empty"), text.alias("text"))
    text = F.col("text")
    rows = letter_counts(texts, text).select(
        "task_id", "draft_id", "ord", "action", "empty", "letters", "own", F.length(text).alias("n"), (tx.fences(text) % 2 == 1).alias("open"),
        F.when((F.col("action") == "create") & ~F.col("is_moc") & (F.length(text) >= 40), md.content_blocks(text, PLACEHOLDER)).alias("blocks"),
    )
    share = F.col("own") / F.greatest("letters", F.lit(1))
    percent = F.bround(share * 100, 0).cast("long")
    rules = (
        ("empty_body", F.col("empty"), ()), ("unbalanced_code_fence", ~F.col("empty") & F.col("open"), ()), ("very_short_note", ~F.col("empty") & (F.col("n") < 40), ()),
        ("note_too_short_structural", ~F.col("empty") & (F.col("blocks") < 3), (F.col("blocks"),)),
        ("note_language_mismatch", ~F.col("empty") & (F.col("letters") >= 200) & (share < 0.3), (percent,)),
    )
    entry = lambda k, code, values: F.struct(F.lit(k).alias("pos"), F.lit(MESSAGES[code][0]).alias("level"), F.lit(code).alias("code"), message(code, *values).alias("message"))
    found = F.array_compact(F.array(*[F.when(test, entry(k, code, values)) for k, (code, test, values) in enumerate(rules)]))
    return rows.withColumn("i", F.explode(found)).select(
        "task_id", F.lit(4).alias("phase"), (F.col("action") == "update").cast("int").alias("late"), F.col("ord").cast("long").alias("ord"), F.lit(1).alias("part"),
        F.col("i.pos").cast("long").alias("pos"), "i.level", "i.code", "i.message", F.col("draft_id").cast("string").alias("draft_id"),
    )


def heading_issues(drafts: DataFrame, headings: DataFrame) -> DataFrame:
    """Planned headings ``note_id, pos, heading`` that the note's text lacks."""
    text = F.when(F.col("body_md") != "", F.col("body_md")).otherwise(F.coalesce("append_section", F.lit("")))
    joined = drafts.where("note_id <> ''").join(headings.select("note_id", F.col("pos").alias("at"), "heading"), "note_id")
    lost = joined.where(~F.contains(text, F.concat(F.lit("## "), F.col("heading"))))
    return lost.select("task_id", *issue("missing_outline_heading", 4, 2, F.col("at"), message("missing_outline_heading", F.col("heading"), F.col("title"))))


def run_validation(
    drafts: DataFrame, notes: DataFrame, deletes: DataFrame | None = None, allow_delete: bool = False, headings: DataFrame | None = None, extra: DataFrame | None = None
) -> DataFrame:
    """``task_id, seq, level, code, message, draft_id``: every task's issues in order.

    Issues that came ``extra`` stand first, then deletes, paths and links; then, draft by draft, new ones
    first, front matter, text and planned headings. ``notes`` has ``path, title``, ``deletes`` ``task_id, path``.
    """
    rows = completed(drafts)
    parts = [path_issues(rows, notes), link_issues(rows, notes), front_issues(rows), body_issues(rows)]
    parts += [delete_issues(deletes, allow_delete)] if deletes is not None else []
    parts += [heading_issues(rows, headings)] if headings is not None else []
    parts += [extra.select(ISSUE)] if extra is not None else []
    every = reduce(DataFrame.unionByName, [p.select(ISSUE) for p in parts])
    order = Window.partitionBy("task_id").orderBy("phase", "late", "ord", "part", "pos")
    return every.select("task_id", F.row_number().over(order).alias("seq"), "level", "code", "message", "draft_id")


def report(issues: DataFrame, tasks: DataFrame) -> DataFrame:
    """``task_id, errors, warnings, ok`` of every task, also of those without an issue."""
    counts = issues.groupBy("task_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    rows = tasks.select("task_id").distinct().join(counts, "task_id", "left").fillna(0, ["errors", "warnings"])
    return rows.withColumn("ok", F.col("errors") == 0)


# --- description -------------------------------------------------------------------------------


def change_report(drafts: DataFrame, deletes: DataFrame, links: DataFrame, issues: DataFrame) -> DataFrame:
    """``task_id, section, ord, lines``: what a task changes, as a reader sees it before accepting it.

    Sections: 0 the task, 1 new notes, 2 updates, 3 deletes, 4 number of new links, 5 the result of
    validation and its issues. ``ord`` -1 is a section's heading. ``links`` has a row for each new link.
    The issues are written once, since three sections read them and a validation is dear.
    """
    rows, issues = completed(drafts), cut(issues)
    # the wording below is fixed, as that of ``MESSAGES``
    tasks = reduce(DataFrame.union, [x.select("task_id") for x in (rows, deletes, links, issues)]).distinct()
    head = tasks.select("task_id", F.lit(0).alias("section"), F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("Задача: "), F.col("task_id").cast("string")).alias("lines"))
    named = rows.withColumnRenamed("unverified_sections", "unverified").withColumn("append_section", F.coalesce("append_section", F.lit("")))
    changes = dr.change_lines(named)
    counted = lambda df, section, before, after: df.groupBy("task_id").agg(F.count("*").cast("string").alias("n")).select(
        "task_id", F.lit(section).alias("section"), F.lit(-1).cast("long").alias("ord"), F.concat(F.lit(before), "n", F.lit(after)).alias("lines")
    )
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("path")) - 1
    gone = deletes.select("task_id", F.lit(3).alias("section"), place.cast("long").alias("ord"), F.concat(F.lit("  - "), "path").alias("lines"))
    checked = report(issues, tasks)
    status = F.concat(
        F.lit("Валидация: "), F.when(F.col("ok"), "OK").otherwise("ЕСТЬ ОШИБКИ"), F.lit(" (errors="), F.col("errors").cast("string"),
        F.lit(", warnings="), F.col("warnings").cast("string"), F.lit(")"),
    )
    result = checked.select("task_id", F.lit(5).alias("section"), F.lit(-1).cast("long").alias("ord"), status.alias("lines"))
    mark = F.when(F.col("level") == "error", "❌").otherwise("⚠️")
    told = issues.select("task_id", F.lit(5).alias("section"), F.col("seq").cast("long").alias("ord"), F.concat(F.lit("  "), mark, F.lit(" ["), "code", F.lit("] "), "message").alias("lines"))
    parts = [head, changes, counted(deletes, 3, "⚠️  УДАЛЕНИЯ (", ") — по умолчанию заблокированы:"), gone, counted(links, 4, "Новые связи (wikilinks): ", ""), result, told]
    return reduce(DataFrame.unionByName, parts)
