"""Drafts of notes: building, merging, describing and committing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import text as tx
from noteloom.operators.assembly import HUMANITIES, HUMANITIES_UPDATE, PLACEHOLDER, assembled, merged

#: Sections from which a note gets its abstract; lengths of digests.
ABSTRACT_SECTIONS, DIGEST_LEAST, DIGEST_MOST, DIGEST_NOTE = 8, 40, 160, 1500
CUT_MARK = "\n\n[…текст автоматически обрезан из-за лимита токенов Groq API…]"


def built(plans: DataFrame, subpoints: DataFrame, sections: DataFrame, annotations: DataFrame) -> DataFrame:
    """Drafts of planned notes: ``note_id, action, path, title, body_md, append_section, tags, links_out, n_unverified``.

    ``plans`` has ``note_id, action, title, folder, existing_path, domain``. New notes take tags,
    links and the abstract of their annotation, the last one if there are several; updates only
    get a section to append. Updates without a path of their own stay out.
    """
    bodies = assembled(subpoints, sections)
    counts = subpoints.groupBy("note_id").agg(F.count("*").alias("n_subpoints"))
    rows = plans.where("action <> 'update' or existing_path is not null").join(bodies, "note_id", "left").join(counts, "note_id", "left")
    rows = rows.join(last_annotation(annotations), "note_id", "left")
    new = F.col("action") == "create"
    warn = F.when(F.col("domain") == "humanities", F.when(new, HUMANITIES).otherwise(HUMANITIES_UPDATE))
    abstract = tx.strip(F.coalesce("abstract", F.lit("")))
    brief = F.when(new & (abstract != "") & (F.col("n_subpoints") >= ABSTRACT_SECTIONS), tx.callout(F.lit("abstract"), F.lit("Кратко"), abstract))
    body = F.concat_ws("\n\n", warn, brief, "body")
    none = F.array().cast("array<string>")
    return rows.select(
        "note_id", "action", F.when(new, tx.note_path(F.col("folder"), F.col("title"))).otherwise(F.col("existing_path")).alias("path"), "title",
        F.when(new, body).otherwise("").alias("body_md"), F.when(~new & (body != ""), body).alias("append_section"),
        F.when(new, tx.add_domain_tag(F.coalesce("tags", none), F.col("domain"))).otherwise(none).alias("tags"),
        F.when(new, F.coalesce("links_out", none)).otherwise(none).alias("links_out"), F.coalesce("n_unverified", F.lit(0)).alias("n_unverified"),
    )


def last_annotation(annotations: DataFrame) -> DataFrame:
    """The last annotation of each note, by ``pos``."""
    row = F.struct("tags", "links_out", "abstract")
    return annotations.groupBy("note_id").agg(F.max_by(row, "pos").alias("a")).select("note_id", "a.*")


def merge_groups(drafts: DataFrame, groups: DataFrame) -> DataFrame:
    """Drafts after merging: each group (``draft_id, g``) of creates becomes one draft in its first one's place.

    A draft outside all groups stays, as does a group of one.
    """
    named = drafts.join(groups, "draft_id", "left")
    sizes = named.where("g is not null and action = 'create'").groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    marked = named.join(sizes, "g", "left")
    joined = merged(marked.where("size is not null and action = 'create'"), "g")
    alone = marked.where("size is null or action <> 'create'").select("ord", "title", "tags", "links_out", "body_md")
    return joined.select("ord", "title", "tags", "links_out", "body_md").unionByName(alone)


# The wording of what a reader is told of drafts, here and in the functions below.


def markers(source: Column, unverified: Column, needs_review: Column, rounds: Column) -> Column:
    """What a reader must know of a draft before accepting it."""
    return F.array_compact(
        F.array(
            F.when(source == "model-knowledge", "⚠ без внешних источников (конспект по знаниям модели)"),
            F.when(F.size(unverified) > 0, F.concat(F.lit("⚠ разделы требуют проверки: "), F.array_join(unverified, ", "))),
            F.when(needs_review, F.concat(F.lit("⚠ критик не одобрил после "), rounds.cast("string"), F.lit(" попыт(ки/ок) переписывания — проверьте вручную"))),
        )
    )


def draft_lines(d: DataFrame) -> Column:
    """The lines that describe one draft in a summary of changes."""
    shown = F.filter("tags", lambda t: ~t.startswith("domain/"))
    tags = F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise("—")
    links = F.array_join(F.transform("links_out", lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), ", ")
    domain, new = tx.domain_of(F.col("tags")), F.col("action") == "create"
    pad = F.lit("      ")
    start = F.substring(F.get(F.split(tx.strip(F.col("append_section")), tx.LINE_END), F.lit(0)), 1, 80)
    own = F.array_compact(
        F.array(
            F.concat(F.when(new, "  + ").otherwise("  ~ "), "path"),
            F.when(new & F.col("is_moc"), "      тип: MOC (оглавление темы)"),
            F.when(new, F.concat(pad, F.lit("заголовок: "), "title")),
            F.when(new & (domain != ""), F.concat(pad, F.lit("домен: "), domain)),
            F.when(new, F.concat(pad, F.lit("теги: "), tags)),
            F.when(new & (F.size("links_out") > 0), F.concat(pad, F.lit("связи: "), links)),
            F.when(~new & (F.col("append_section") != ""), F.concat(pad, F.lit("добавляется секция, начинается с: "), start, F.lit("…"))),
        )
    )
    notes = markers(F.col("source"), F.col("unverified"), F.col("needs_review"), F.col("critic_rounds"))
    return F.array_join(F.concat(own, F.transform(notes, lambda m: F.concat(pad, m))), "\n")


def change_lines(drafts: DataFrame) -> DataFrame:
    """``task_id, section, ord, lines``: the summary of a task's changes as ordered rows, new notes before updates.

    Section 0 is a heading with the number of drafts of its kind.
    """
    kind = F.when(F.col("action") == "create", 1).otherwise(2).alias("section")
    rows = drafts.select("task_id", kind, "ord", draft_lines(drafts).alias("lines"))
    heads = rows.groupBy("task_id", "section").agg(F.count("*").cast("string").alias("n"))
    name = F.when(F.col("section") == 1, "НОВЫЕ ЗАМЕТКИ (").otherwise("ДОПОЛНЯЕМЫЕ ЗАМЕТКИ (")
    return rows.unionByName(heads.select("task_id", "section", F.lit(-1).cast("long").alias("ord"), F.concat(name, "n", F.lit("):")).alias("lines")))


def digest(notes: DataFrame, subpoints: DataFrame, sections: DataFrame) -> DataFrame:
    """``note_id, digest``: a note's title and the start of each section, within a budget for all of them."""
    last = sections.groupBy("note_id", "ord").agg(F.max_by("markdown", "pos").alias("markdown"))
    rows = subpoints.join(last, ["note_id", "ord"], "left").withColumn("plain", tx.plain_text(F.coalesce("markdown", F.lit(""))))
    lists = rows.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("ord", "heading", "plain"))).alias("s"))
    room = F.greatest(F.lit(DIGEST_LEAST), F.least(F.lit(DIGEST_MOST), F.floor(F.lit(DIGEST_NOTE) / F.greatest(F.size("s"), F.lit(1))))).cast("int")
    line = lambda x: F.concat(F.lit("- "), x["heading"], F.when(x["plain"] != "", F.concat(F.lit(": "), tx.cut_at_space(x["plain"], F.col("room")))).otherwise(""))
    joined = notes.join(lists.withColumn("room", room), "note_id", "left")
    return joined.select("note_id", F.concat_ws("\n", F.concat(F.lit("Заметка: "), "title"), F.array_join(F.transform("s", line), "\n")).alias("digest"))


def clean_links(raw: Column, own_title: Column, titles: Column) -> Column:
    """Links that lead to a known title (a map by normalized title), without the note itself and repeats, in order."""
    known = F.map_values(titles)
    sent = F.transform(raw, lambda x: tx.snapped(x, titles))
    real = F.filter(sent, lambda x: x.isNotNull() & F.array_contains(known, x) & (tx.normalized_title(x) != tx.normalized_title(own_title)))
    return F.array_distinct(real)


def overview_description(abstract: Column, body: Column) -> Column:
    """The abstract on one line, else the first sentence of the note's prose."""
    flat = tx.strip(F.regexp_replace(F.coalesce(abstract, F.lit("")), tx.SPACE, " "))
    prose = F.replace(body, F.lit(PLACEHOLDER), F.lit(""))
    return F.when(flat != "", flat).otherwise(tx.first_sentence(tx.plain_text(prose, skip_quotes=True)))


def sources_block(refs: Column) -> Column:
    lines = F.array_join(F.transform(refs, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(refs) > 0, F.concat(F.lit("## Источники\n\n"), lines, F.lit("\n\n"))).otherwise("")


def committed(vault: DataFrame, drafts: DataFrame, deletes: DataFrame, allow_delete: bool, ok: bool) -> DataFrame:
    """``path, content`` after a changeset: creates appear, updates get their section appended, deletes go.

    A changeset that didn't pass validation, that deletes without leave, or whose drafts conflict with the vault or
    each other is refused. ``commit`` keeps collections as versions and tells every conflict.
    """
    if not ok:
        raise ValueError("the changeset hasn't passed validation")
    if not allow_delete and not deletes.isEmpty():
        raise ValueError("the changeset deletes, which isn't allowed")
    added = drafts.where("action = 'create'").select("path", F.col("body_md").alias("content"))
    sides = drafts.groupBy("path").agg(F.count_if(F.col("action") == "create").alias("n"), F.count_if(F.col("action") == "update").alias("m"))
    there = sides.join(vault.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    clash = there.where("n > 1 or (n > 0 and there) or m > 1 or (m > 0 and n = 0 and there is null)").select("path").first()
    if clash:
        raise ValueError(f"the changeset conflicts at {clash.path}")
    more = drafts.where("action = 'update'").select("path", tx.collapse_brackets(tx.strip(F.col("append_section"))).alias("more"))
    kept = vault.join(deletes, "path", "left_anti").join(more, "path", "left")
    content = F.when(F.col("more").isNotNull() & (F.col("more") != ""), F.concat(F.regexp_replace("content", r"(?U)\s+$", ""), F.lit("\n\n"), "more", F.lit("\n")))
    return kept.select("path", F.coalesce(content, "content").alias("content")).unionByName(added.join(deletes, "path", "left_anti"))


def with_tags_and_front(notes: DataFrame, tags: DataFrame, front: DataFrame) -> DataFrame:
    """Notes with their tags as a sorted array and their front matter as a map."""
    t = tags.groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    f = front.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value")))).alias("frontmatter"))
    return notes.join(t, "path", "left").join(f, "path", "left")


def limit_error(message: Column) -> Column:
    """Which limit of the model an error message tells of, if any."""
    low = F.lower(message)
    rate = low.contains("429") | low.contains("rate limit") | low.contains("rate_limit")
    large = low.contains("413") | low.contains("request_too_large") | low.contains("request entity too large")
    return F.when(rate, "rate_limit").when(large, "too_large").otherwise("other")


def retry_after(message: Column) -> Column:
    return F.regexp_extract(message, r"(?i)try again in\s+([\d.]+)\s*s", 1).try_cast("double")


def shortened(prompt: Column, most_tokens: int) -> Column:
    """A prompt cut to a budget of tokens at a line or sentence end near the cut, with a mark."""
    per = F.length(prompt) / F.greatest(tx.estimated_tokens(prompt), F.lit(1))
    allowed = F.greatest(F.lit(most_tokens) - tx.estimated_tokens(F.lit(CUT_MARK)), F.lit(50))
    room = F.floor(allowed * per * 0.92).cast("int")
    head = F.regexp_replace(F.substr(prompt, F.lit(1), room), r"(?U)\s+$", "")
    back = F.reverse(head)
    ends = [F.when(F.locate(mark, back) > 0, F.length(head) - F.locate(mark, back) - (len(mark) - 1)).otherwise(-1) for mark in ("\n", " .")]
    end = F.greatest(*ends)
    return F.when(F.length(prompt) <= room, prompt).otherwise(F.concat(F.when(end > room * 0.7, F.substr(head, F.lit(1), end + 1)).otherwise(head), F.lit(CUT_MARK)))


def calibrated(estimate: Column, ratio: Column) -> Column:
    """An estimate times the role's observed ratio, at least 1; as it is while nothing was observed."""
    return F.when(ratio.isNull(), estimate).otherwise(F.greatest(F.floor(estimate * ratio).cast("long"), F.lit(1).cast("long")))


def output_reserve(average: Column, default: int, least: int = 300) -> Column:
    return F.when(average.isNull(), F.lit(default)).otherwise(F.greatest(F.floor(average), F.lit(least))).cast("long")
