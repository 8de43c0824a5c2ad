"""Queries of drafts, plans and single functions with their DuckDB oracles; they join those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.functions import markdown as md
from noteloom.functions import text as tx
from noteloom.operators import assembly, drafts, planning, validation
from noteloom.plans.catalog import CALLS, NOTES, PATHS, query, validate_paths
from noteloom.sources import virtual_vault as vv

PLACEHOLDER = assembly.PLACEHOLDER


def conversations(spark, d):
    return vv.read(spark, d, "conversations").where("text is not null")


def text_rows(spark, d):
    """Turns with Markdown around their words, so that the functions have something to do."""
    return conversations(spark, d).select("conv_id", "turn", "text", F.col("turn").cast("string").alias("n"))


#: A turn's key with its text.
C = "SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL"
PLAN = f"""p AS (SELECT conv_id AS note_id, CASE WHEN conv_id % 3 = 0 THEN 'update' ELSE 'create' END AS action, 'Chat ' || conv_id AS title,
    ['technical', 'humanities', 'life_management'][CAST(conv_id % 3 AS INT) + 1] AS domain, count(*) AS n FROM ({C}) GROUP BY conv_id),
  b AS (SELECT conv_id AS note_id, string_agg('## ' || turn || CASE WHEN turn % 4 = 3 THEN chr(10) || chr(10) || '> [!warning] Требует проверки' || chr(10)
      || '> Детали этого раздела могут быть неточными.' ELSE '' END || chr(10) || chr(10)
      || CASE WHEN turn % 4 = 3 OR trim(text) = '' THEN '{PLACEHOLDER}' ELSE trim(text) END, chr(10) || chr(10) ORDER BY turn) AS body,
    count(*) FILTER (turn % 4 = 3) AS n_unverified FROM ({C}) GROUP BY conv_id)"""


def plan(spark, d):
    c = conversations(spark, d)
    subpoints = c.select(F.col("conv_id").alias("note_id"), F.col("turn").alias("ord"), F.col("turn").cast("string").alias("heading"))
    sections = c.where("turn % 4 <> 3").select(F.col("conv_id").alias("note_id"), F.col("turn").alias("ord"), F.col("text").alias("markdown"), F.lit(False).alias("needs_check"), F.lit(0).alias("pos"))
    domain = F.get(F.array(F.lit("technical"), F.lit("humanities"), F.lit("life_management")), (F.col("note_id") % 3).cast("int"))
    name = F.concat(F.lit("Chat "), F.col("note_id").cast("string"))
    notes = subpoints.select("note_id").distinct().select(
        "note_id", F.when(F.col("note_id") % 3 == 0, "update").otherwise("create").alias("action"), name.alias("title"), F.lit("chats").alias("folder"),
        F.concat(F.lit("old/"), F.col("note_id").cast("string"), F.lit(".md")).alias("existing_path"), domain.alias("domain"),
    )
    return notes, subpoints, sections


def annotations(spark, d):
    """Two for each conversation; the later one counts."""
    c = conversations(spark, d).where("turn < 2")
    tag = F.array(F.concat(F.lit("t"), (F.col("conv_id") % 7).cast("string")), F.concat(F.lit("turn"), F.col("turn").cast("string")))
    links_out = F.array(F.concat(F.lit("Chat "), (F.col("conv_id") + 1).cast("string")))
    return c.select(F.col("conv_id").alias("note_id"), tag.alias("tags"), links_out.alias("links_out"), F.concat(F.lit("About "), F.length("text").cast("string")).alias("abstract"), F.col("turn").alias("pos"))


NOTED = f"n AS (SELECT conv_id AS note_id, max_by(length(text), turn) AS len, max(turn) AS pos FROM ({C}) WHERE turn < 2 GROUP BY 1)"


@query(f"WITH {NOTED} SELECT note_id, 't' || note_id % 7 || '|turn' || pos AS tags, 'About ' || len AS abstract FROM n")
def note_annotations(spark, d):
    return drafts.last_annotation(annotations(spark, d)).select("note_id", F.array_join("tags", "|").alias("tags"), "abstract")


@query(f"""WITH {PLAN}, {NOTED}, h AS (SELECT p.*, b.n_unverified, len, pos,
    CASE WHEN domain <> 'humanities' THEN '' WHEN action = 'create' THEN '{assembly.HUMANITIES}' || chr(10) || chr(10) ELSE '{assembly.HUMANITIES_UPDATE}' || chr(10) || chr(10) END
    || CASE WHEN action = 'create' AND n >= 8 AND len IS NOT NULL THEN '> [!abstract] Кратко' || chr(10) || '> About ' || len || chr(10) || chr(10) ELSE '' END || body AS whole
    FROM p JOIN b USING (note_id) LEFT JOIN n USING (note_id))
  SELECT note_id, CASE WHEN action = 'create' THEN 'chats/' || title || '.md' ELSE 'old/' || note_id || '.md' END AS path, CASE WHEN action = 'create' THEN whole ELSE '' END AS body_md,
    CASE WHEN action = 'update' THEN whole END AS append_section, n_unverified,
    CASE WHEN action = 'update' THEN '' ELSE CASE WHEN len IS NULL THEN '' ELSE 't' || note_id % 7 || '|turn' || pos || '|' END || 'domain/' || domain END AS tags,
    CASE WHEN action = 'create' AND len IS NOT NULL THEN 'Chat ' || (note_id + 1) ELSE '' END AS links_out FROM h"""
)
def built_drafts(spark, d):
    out = drafts.built(*plan(spark, d), annotations(spark, d))
    joined = {c: F.array_join(c, "|").alias(c) for c in ("tags", "links_out")}
    return out.select("note_id", "path", "body_md", "append_section", "n_unverified", *joined.values())


@query(f"""WITH r AS (SELECT *, regexp_replace(trim(regexp_replace(text, '[*`]', '', 'g')), '\\s*[\\n\\r]+\\s*', ' ', 'g') AS plain, count(*) OVER (PARTITION BY conv_id) AS n FROM ({C})),
  k AS (SELECT *, greatest(40, least(160, CAST(floor(1500 / n) AS INT))) AS room FROM r)
  SELECT conv_id AS note_id, 'Заметка: Chat ' || conv_id || chr(10) || string_agg('- ' || turn || CASE WHEN turn % 4 = 3 OR plain = '' THEN '' ELSE ': ' ||
    CASE WHEN length(plain) <= room THEN plain ELSE regexp_replace(substr(plain, 1, room), ' [^ ]*$', '') || '…' END END, chr(10) ORDER BY turn) AS digest FROM k GROUP BY conv_id""")
def annotation_digest(spark, d):
    notes, subpoints, sections = plan(spark, d)
    return drafts.digest(notes, subpoints, sections)


@query(f"""WITH {NOTES}, g AS (SELECT *, doc_id % 3 <> 0 AS cr, doc_id - doc_id % 6 AS g FROM notes),
  s AS (SELECT *, count(*) FILTER (cr) OVER (PARTITION BY g) AS size FROM g),
  j AS (SELECT min(doc_id) AS ord, string_agg(title, ' + ' ORDER BY doc_id) AS title, string_agg('## ' || title || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY doc_id) AS body
    FROM s WHERE cr AND size > 1 GROUP BY g UNION ALL SELECT doc_id, title, body FROM s WHERE NOT cr OR size <= 1)
  SELECT ord, title, sha256(body) AS body_sha256, length(body) AS n_chars FROM j""")
def merge_groups(spark, d):
    rows = note_drafts(spark, d)
    out = drafts.merge_groups(rows, rows.select("draft_id", (F.col("ord") - F.col("ord") % 6).alias("g")))
    return out.select("ord", "title", F.sha2("body_md", 256).alias("body_sha256"), F.length("body_md").cast("long").alias("n_chars"))


@query(f"""WITH {NOTES}, g AS (SELECT *, doc_id % 3 <> 0 AS cr, CAST(floor(doc_id / 10) AS BIGINT) AS task FROM notes),
  s AS (SELECT *, count(*) FILTER (cr) OVER (PARTITION BY task) AS size FROM g)
  SELECT min(doc_id) AS ord, string_agg(title, ' + ' ORDER BY doc_id) AS title FROM s WHERE cr AND size > 1 GROUP BY task
  UNION ALL SELECT doc_id, title FROM s WHERE NOT cr OR size <= 1""")
def merge_all_creates(spark, d):
    """All new drafts of a task as one; updates stay."""
    rows = note_drafts(spark, d)
    return drafts.merge_groups(rows, rows.select("draft_id", F.col("task_id").alias("g"))).select("ord", "title")


def note_drafts(spark, d):
    """Drafts of the virtual vault: every third one an update, every twentieth a map, ten to a task."""
    n = vv.notes(spark, d)
    new, k = F.col("doc_id") % 3 != 0, F.col("doc_id")
    none = F.array().cast("array<string>")
    return n.select(
        k.alias("draft_id"), F.floor(k / 10).cast("long").alias("task_id"), k.alias("ord"), F.when(new, "create").otherwise("update").alias("action"), "path", "title",
        F.when(new, F.concat("tags", F.array(F.concat(F.lit("domain/"), F.get("tags", F.lit(0)))))).otherwise(none).alias("tags"),
        F.when(new, F.array(F.concat(F.lit("Note "), (k + 1).cast("string")))).otherwise(none).alias("links_out"), F.col("body").alias("body_md"),
        F.when(~new, F.col("body")).otherwise("").alias("append_section"), (k % 20 == 0).alias("is_moc"), F.when(k % 4 == 0, "model-knowledge").otherwise("").alias("source"),
        F.when(k % 5 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(none).alias("unverified"), (k % 7 == 0).alias("needs_review"), (k % 5).alias("critic_rounds"),
    )


@query(f"""WITH {NOTES}, r AS (SELECT *, doc_id % 3 <> 0 AS cr, CAST(floor(doc_id / 10) AS BIGINT) AS task_id FROM notes),
  m AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN chr(10) || '      ⚠ без внешних источников (конспект по знаниям модели)' ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '      ⚠ разделы требуют проверки: A, B' ELSE '' END
    || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '      ⚠ критик не одобрил после ' || doc_id % 5 || ' попыт(ки/ок) переписывания — проверьте вручную' ELSE '' END AS marks FROM r),
  l AS (SELECT task_id, CASE WHEN cr THEN 1 ELSE 2 END AS section, doc_id AS ord, CASE WHEN cr THEN '  + ' || path || CASE WHEN doc_id % 20 = 0 THEN chr(10) || '      тип: MOC (оглавление темы)' ELSE '' END
      || chr(10) || '      заголовок: ' || title || chr(10) || '      домен: ' || tags[1] || chr(10) || '      теги: ' || array_to_string(tags, ', ') || chr(10) || '      связи: [[Note ' || (doc_id + 1) || ']]'
    ELSE '  ~ ' || path || CASE WHEN body <> '' THEN chr(10) || '      добавляется секция, начинается с: ' || substr(string_split(trim(body, chr(10) || ' '), chr(10))[1], 1, 80) || '…' ELSE '' END END || marks AS lines FROM m)
  SELECT task_id, section, ord, lines FROM l
  UNION ALL SELECT task_id, section, -1, CASE section WHEN 1 THEN 'НОВЫЕ ЗАМЕТКИ (' ELSE 'ДОПОЛНЯЕМЫЕ ЗАМЕТКИ (' END || count(*) || '):' FROM l GROUP BY task_id, section""")
def change_summary(spark, d):
    return drafts.change_lines(note_drafts(spark, d))


@query(f"""WITH {NOTES} SELECT doc_id AS draft_id, CAST((doc_id % 4 = 0)::INT + (doc_id % 5 = 0)::INT + (doc_id % 7 = 0)::INT AS INT) AS n_markers FROM notes""")
def note_markers(spark, d):
    marks = drafts.markers(F.col("source"), F.col("unverified"), F.col("needs_review"), F.col("critic_rounds"))
    return note_drafts(spark, d).select("draft_id", F.size(marks).alias("n_markers"))


@query(f"WITH {NOTES} SELECT CAST(floor(doc_id / 10) AS BIGINT) AS task_id, count(*) FILTER (doc_id % 3 <> 0) AS creates, count(*) FILTER (doc_id % 3 = 0) AS updates FROM notes GROUP BY 1")
def draft_split(spark, d):
    new = F.col("action") == "create"
    return note_drafts(spark, d).groupBy("task_id").agg(F.count_if(new).alias("creates"), F.count_if(~new).alias("updates"))


@query(f"""WITH {NOTES} SELECT path, array_to_string(list_sort(tags), '|') AS tags, 'id=' || doc_id || ',lang=' || tags[1] AS front FROM notes""")
def joined_index(spark, d):
    n = vv.notes(spark, d)
    tags = n.select("path", F.explode("tags").alias("tag"))
    pairs = F.array(F.struct(F.lit("id").alias("key"), F.col("doc_id").cast("string").alias("value")), F.struct(F.lit("lang").alias("key"), F.get("tags", F.lit(0)).alias("value")))
    out = drafts.with_tags_and_front(n.select("path"), tags, n.select("path", F.explode(pairs).alias("p")).select("path", "p.key", "p.value"))
    entries = F.transform(F.map_entries("frontmatter"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("path", F.array_join("tags", "|").alias("tags"), F.array_join(F.array_sort(entries), ",").alias("front"))


@query(f"WITH {NOTES} SELECT path FROM notes WHERE doc_id % 11 <> 0 AND doc_id % 5 <> 0")
def notes_with_hash(spark, d):
    """Notes that are in the index with the very content they have."""
    n = vv.notes(spark, d)
    index = n.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, F.lit("0" * 16)).otherwise(F.col("content_hash")).alias("content_hash"))
    return n.join(index, ["path", "content_hash"], "left_semi").select("path")


@query(f"WITH {NOTES} SELECT path, title, length(body) AS n_chars FROM notes WHERE path IN (SELECT min(path) FROM notes)")
def note_by_path(spark, d):
    n = vv.notes(spark, d)
    return n.join(n.agg(F.min("path").alias("path")), "path", "left_semi").select("path", "title", F.length("body").cast("long").alias("n_chars"))


@query("SELECT page_id FROM pages WHERE html IS NOT NULL AND html <> '' AND page_id % 3 <> 0")
def fetched_pages(spark, d):
    p = vv.read(spark, d, "pages").withColumn("text", F.when(F.col("page_id") % 3 != 0, F.col("html")))
    return p.where("text is not null and text <> ''").select("page_id")


@query(f"""WITH {NOTES}, v AS (SELECT path, body AS content FROM notes WHERE doc_id % 2 = 0)
  SELECT path, sha256(content) AS sha256 FROM (
    SELECT v.path, CASE WHEN n.doc_id % 3 = 0 THEN rtrim(content, chr(10) || ' ') || chr(10) || chr(10) || 'New [[Note ' || n.doc_id || ']]' || chr(10) ELSE content END AS content
    FROM v JOIN notes n USING (path) WHERE n.doc_id % 10 <> 4
    UNION ALL SELECT path, body FROM notes WHERE doc_id % 2 = 1)""")
def commit_snapshot(spark, d):
    n = vv.notes(spark, d)
    old = n.where("doc_id % 2 = 0").select("path", F.col("body").alias("content"))
    more = F.concat(F.lit(" New [[[[Note "), F.col("doc_id").cast("string"), F.lit("]]]]\n"))
    changed = n.where("doc_id % 2 = 1").select("path", "body", F.lit("create").alias("action"), F.lit("").alias("more")).unionByName(
        n.where("doc_id % 6 = 0").select("path", "body", F.lit("update").alias("action"), more.alias("more"))
    )
    rows = changed.select("path", "action", F.col("body").alias("body_md"), F.col("more").alias("append_section"))
    return drafts.committed(old, rows, n.where("doc_id % 10 = 4").select("path"), True, True).select("path", F.sha2("content", 256).alias("sha256"))


@query(f"""WITH {NOTES}, {PATHS}, e AS (SELECT CAST(floor(draft_id / 20) AS BIGINT) AS task_id, code FROM iss UNION ALL
    SELECT DISTINCT CAST(floor(doc_id / 20) AS BIGINT), 'delete_not_allowed' FROM notes WHERE doc_id % 50 = 0)
  SELECT task_id, count(*) AS errors, 0 AS warnings, false AS ok FROM e GROUP BY task_id""")
def validation_report(spark, d):
    """Errors, warnings and ``ok`` of each task with issues: paths and deletes."""
    n = vv.notes(spark, d)
    task = F.floor(F.col("draft_id") / 20).cast("long").alias("task_id")
    gone = validation.delete_codes(n.where("doc_id % 50 = 0").select(F.floor(F.col("doc_id") / 20).cast("long").alias("task_id")), False)
    return validation.report(validate_paths(spark, d).select(task, "code").unionByName(gone))


@query(f"WITH {NOTES} SELECT DISTINCT CAST(floor(doc_id / 20) AS BIGINT) AS task_id, 'delete_not_allowed' AS code FROM notes WHERE doc_id % 50 = 0")
def delete_guard(spark, d):
    return validation.delete_codes(vv.notes(spark, d).where("doc_id % 50 = 0").select(F.floor(F.col("doc_id") / 20).cast("long").alias("task_id")), False)


@query(f"""WITH {NOTES} SELECT doc_id AS draft_id, 'yaml_unsupported_type' AS code FROM notes WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, 'empty_title' FROM notes WHERE doc_id % 9 = 0""")
def front_matter_check(spark, d):
    n = vv.notes(spark, d)
    kinds = F.array(F.lit("string"), F.when(F.col("doc_id") % 4 == 1, "object").otherwise("number"))
    title = F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("title"))
    return n.select(F.col("doc_id").alias("draft_id"), F.explode(validation.front_matter_codes(title, kinds)).alias("code"))


@query(f"""WITH {NOTES} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Note ' || (doc_id + 1) || CASE WHEN doc_id % 2 = 0 THEN '|Note ' || (doc_id + 2) ELSE '' END END AS links FROM notes""")
def clean_links(spark, d):
    """Known titles are those of the next two notes and the note's own."""
    n = vv.notes(spark, d)
    title = lambda k: F.concat(F.lit("Note "), (F.col("doc_id") + k).cast("string"))
    titles = F.map_from_arrays(F.transform(F.array(title(0), title(1), title(2)), tx.normalized_title), F.array(title(0), title(1), title(2)))
    second = F.when(F.col("doc_id") % 2 == 0, title(2)).otherwise(F.lit("Red link"))
    raw = F.when(F.col("doc_id") % 5 == 0, F.array(title(0), F.lit("https://x"))).otherwise(F.array(F.concat(F.lit("[["), title(1), F.lit("]]")), title(0), second, title(1), F.lit("")))
    return n.select("doc_id", F.array_join(drafts.clean_links(raw, F.col("title"), titles), "|").alias("links"))


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'A ' || turn ELSE regexp_replace(trim(text), '\\s+', ' ', 'g') END AS description
  FROM ({C}) WHERE turn % 2 = 0 OR (length(text) < 150 AND NOT regexp_matches(text, '[.!?]\\s') AND NOT regexp_matches(text, '[*`#>|\\[]'))""")
def overview_descriptions(spark, d):
    r = text_rows(spark, d).where(F.expr("turn % 2 = 0") | ((F.length("text") < 150) & ~F.col("text").rlike(r"[.!?]\s") & ~F.col("text").rlike(r"[*`#>|\[]")))
    abstract = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" A\n "), "n", F.lit(" ")))
    body = F.concat(F.lit("## H\n\n> [!note] x\n> y\n\n"), F.lit(PLACEHOLDER), F.lit("\n"), "text")
    return r.select("conv_id", "turn", drafts.overview_description(abstract, body).alias("description"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE '## Источники' || chr(10) || chr(10) || '- ' || url || chr(10) || '- https://second' || chr(10) || chr(10) END AS block FROM pages")
def sources_blocks(spark, d):
    refs = F.when(F.col("page_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("url", F.lit("https://second")))
    return vv.read(spark, d, "pages").select("page_id", drafts.sources_block(refs).alias("block"))


@query(f"SELECT conv_id, turn, '### ' || turn || chr(10) || trim(text, chr(10) || ' ') AS text, turn % 2 = 0 AS balanced FROM ({C}) WHERE NOT regexp_matches(text, '[`#\\[<|]|[А-я]|‑|\\r')")
def prepared_sections(spark, d):
    r = text_rows(spark, d).where(~F.col("text").rlike(r"[`#\[<|]|[А-я]|‑|\r"))
    raw = F.concat(F.lit("\n# Heading\n\n### "), "n", F.lit("\n"), F.btrim("text", F.lit(" \n")), F.when(F.col("turn") % 2 == 1, "\n```").otherwise(""))
    text, balanced = tx.prepared_section(raw, F.lit("heading"))
    return r.select("conv_id", "turn", F.regexp_replace(text, "\n```$", "").alias("text"), balanced.alias("balanced"))


@query(f"SELECT conv_id AS note_id, count(*) FILTER (turn % 3 = 1) AS resets FROM ({C}) GROUP BY conv_id")
def plan_domain_change(spark, d):
    """Plans moved to another domain: kinds that it doesn't know become ``other``, and these are counted."""
    kind = F.get(F.array(F.lit("context"), F.lit("definition"), F.lit("other")), (F.col("turn") % 3).cast("int"))
    plans = conversations(spark, d).groupBy(F.col("conv_id").alias("note_id")).agg(F.collect_list(kind).alias("kinds"))
    return planning.moved(plans, "humanities").select("note_id", "resets")


@query(f"""WITH l AS (SELECT conv_id AS note_id, list(turn::VARCHAR ORDER BY turn) AS h FROM ({C}) GROUP BY conv_id)
  SELECT note_id, array_to_string(list_concat(['Renamed'], h[3:], ['New']), '|') AS headings FROM l""")
def plan_edits(spark, d):
    """The first subpoint renamed, the second one removed, a new one added."""
    plans = conversations(spark, d).groupBy(F.col("conv_id").alias("note_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("turn").cast("string").alias("h")))).alias("s"))
    items = F.transform("s", lambda x: x["h"])
    edited = planning.added(planning.removed(planning.renamed(items, 0, F.lit("Renamed")), 1), F.lit("New"))
    return plans.select("note_id", F.array_join(edited, "|").alias("headings"))


@query(f"""WITH k AS (SELECT *, CAST(conv_id % 5 AS INT) + 1 AS a, CAST(turn AS INT) + 1 AS b FROM ({C}))
  SELECT conv_id, turn, CASE WHEN b + 2 > 6 THEN NULL ELSE array_to_string(list_reverse(list_sort(list_distinct([a - 1, b - 1, b, b + 1]))), ',') END AS places FROM k""")
def index_selection(spark, d):
    said = F.concat((F.col("conv_id") % 5 + 1).cast("string"), F.lit(", "), (F.col("turn") + 3).cast("string"), F.lit("-"), (F.col("turn") + 1).cast("string"))
    return text_rows(spark, d).select("conv_id", "turn", F.array_join(md.selection(said, 6).cast("array<string>"), ",").alias("places"))


@query(f"""SELECT event_id, CASE k % 4 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'too_large' ELSE 'other' END AS kind, CASE WHEN k % 4 = 0 THEN tokens + 0.5::DOUBLE END AS wait
  FROM (WITH {CALLS} SELECT * FROM calls)""")
def error_classes(spark, d):
    c = vv.calls(spark, d)
    said = F.when(F.col("k") % 4 == 0, F.concat(F.lit("Error 429: Please TRY again in "), F.col("tokens").cast("string"), F.lit(".5s"))).when(F.col("k") % 4 == 1, "Request Entity Too Large").otherwise("boom")
    return c.select("event_id", drafts.limit_error(said).alias("kind"), drafts.retry_after(said).alias("wait"))


@query(f"""WITH {CALLS} SELECT event_id, CASE WHEN k % 3 = 0 THEN tokens ELSE greatest(CAST(floor(tokens * (k % 5) / 4.0::DOUBLE) AS BIGINT), 1) END AS estimate,
  CASE WHEN k % 3 = 0 THEN 800 ELSE greatest(tokens * 10, 300) END AS reserve FROM calls""")
def calibrated_estimates(spark, d):
    ratio = F.when(F.col("k") % 3 != 0, (F.col("k") % 5) / F.lit(4.0))
    average = F.when(F.col("k") % 3 != 0, F.col("tokens") * 10.0)
    return vv.calls(spark, d).select("event_id", drafts.calibrated(F.col("tokens"), ratio).alias("estimate"), drafts.output_reserve(average, 800).alias("reserve"))


@query(f"""WITH e AS (SELECT doc_id, text, CASE WHEN length(text) > 0 THEN CAST(floor(length(text) / 4.0::DOUBLE) AS BIGINT) + 1 ELSE 0 END AS t FROM documents WHERE text IS NOT NULL),
  r AS (SELECT *, CAST(floor((200 - {len(drafts.CUT_MARK) * 10 // 23 + 1}) * (length(text) / greatest(t, 1)::DOUBLE) * 0.92::DOUBLE) AS BIGINT) AS room FROM e),
  h AS (SELECT *, regexp_replace(substr(text, 1, room), '\\s+$', '') AS head FROM r),
  b AS (SELECT *, greatest(length(head) - instr(reverse(head), chr(10)) + CASE WHEN instr(reverse(head), chr(10)) = 0 THEN -length(head) - 1 ELSE 0 END,
    length(head) - instr(reverse(head), ' .') - 1 + CASE WHEN instr(reverse(head), ' .') = 0 THEN -length(head) ELSE 0 END) AS last FROM h)
  SELECT doc_id, sha256(CASE WHEN length(text) <= room THEN text ELSE CASE WHEN last > room * 0.7::DOUBLE THEN substr(head, 1, last + 1) ELSE head END || MARK END) AS sha256 FROM b""".replace("MARK", "'" + drafts.CUT_MARK.replace("\n", "' || chr(10) || '") + "'"))
def shortened_prompts(spark, d):
    t = vv.read(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.sha2(drafts.shortened(F.col("text"), 200), 256).alias("sha256"))


@query(f"""WITH r AS (SELECT conv_id, turn, 'chats/' || turn || '/x' AS path FROM ({C}))
  SELECT conv_id, turn, 'in/Turn ' || turn || ' x.md' AS path, 'x' AS stem, 'b|z' AS tags, 'Chat ' || conv_id AS links, 'A ' || turn AS bare, 'Note-' || turn AS dashed FROM r""")
def note_functions(spark, d):
    """Paths, stems, tags, links, brackets and dashes of rows made from turns."""
    r = text_rows(spark, d)
    path = F.concat(F.lit("chats/"), "n", F.lit("/x.md"))
    body = F.concat(F.lit("see [[Chat "), F.col("conv_id").cast("string"), F.lit("#top|it]] and #z a#q"))
    return r.select(
        "conv_id", "turn", tx.note_path(F.lit("/in/"), F.concat(F.lit(' Turn "'), "n", F.lit('"/x: '))).alias("path"), tx.stem(path).alias("stem"),
        F.array_join(tx.all_tags(F.array(F.lit("##b")), body), "|").alias("tags"), F.array_join(tx.wikilinks(body), "|").alias("links"),
        tx.strip_brackets(F.concat(F.lit("[[[[[ [A "), "n", F.lit("]]]]] ]"))).alias("bare"), tx.normalized_title(F.concat(F.lit(" Note–"), "n")).alias("dashed"),
    )


@query(f"""SELECT conv_id, turn, '### ' || turn || chr(10) || '```' || chr(10) || '# x' || chr(10) || '```' || chr(10) || '#### y' AS within,
  '## ' || turn AS shifted, 'body ' || turn AS bare, 'Plain link ' || turn AS plain, 'First ' || turn || '.' AS sentence, 'domain/d' || turn AS tagged FROM ({C})""")
def section_functions(spark, d):
    """Headings, plain text, first sentences and domain tags of rows made from turns."""
    r = text_rows(spark, d)
    raw = F.concat(F.lit("### "), "n", F.lit("\n```\n# x\n```\n###### y"))
    return r.select(
        "conv_id", "turn", tx.headings_within(raw).alias("within"), tx.headings_within(F.concat(F.lit("# "), "n"), 1, 6, 1).alias("shifted"),
        tx.without_own_heading(F.concat(F.lit("\n## Title ##\nbody "), "n"), F.lit("title")).alias("bare"),
        tx.plain_text(F.concat(F.lit("# h\n| t |\n**Plain** [[x|link]] "), "n")).alias("plain"),
        tx.first_sentence(F.concat(F.lit(" First "), "n", F.lit(".\nSecond one."))).alias("sentence"),
        F.array_join(tx.add_domain_tag(tx.add_domain_tag(F.array().cast("array<string>"), F.concat(F.lit("d"), "n")), F.concat(F.lit("d"), "n")), "|").alias("tagged"),
    )


@query(f"WITH {NOTES} SELECT g, bool_or(c > 1) AS overlap FROM (SELECT doc_id - doc_id % 10 AS g, doc_id % 4 AS v, count(*) AS c FROM notes WHERE doc_id % 10 < 5 OR doc_id % 3 = 0 GROUP BY 1, 2) GROUP BY g")
def overlap_check(spark, d):
    """Whether merge groups name a draft more than once."""
    n = vv.notes(spark, d).where("doc_id % 10 < 5 or doc_id % 3 = 0")
    members = n.groupBy((F.col("doc_id") - F.col("doc_id") % 10).alias("g")).agg(F.collect_list(F.col("doc_id") % 4).alias("m"))
    return members.select("g", (F.size(F.array_distinct("m")) < F.size("m")).alias("overlap"))


@query(f"WITH {NOTES} SELECT path, title, array_to_string(list_sort(tags), '|') AS tags, 'Note ' || (doc_id + 1) AS links, length(regexp_replace(trim(body, chr(10) || ' '), '\\s', '', 'g')) AS n_chars FROM notes")
def parsed_notes(spark, d):
    """Notes rendered to Markdown files' content and parsed again."""
    from noteloom.sources import notes as files

    n = vv.notes(spark, d)
    none = F.lit("")
    raw = files.rendered(F.col("title"), F.col("tags"), F.lit("2024-01-01"), none, F.col("body"), F.array(F.concat(F.lit("Note "), (F.col("doc_id") + 1).cast("string"))), F.lit(False))
    out = files.parse_notes(n.select("path", raw.alias("raw_content")))
    prose = F.regexp_replace(F.regexp_replace("body", r"(?s)## Связанные заметки.*$", ""), r"\s", "")
    return out.select("path", "title", F.array_join("tags", "|").alias("tags"), F.array_join("outlinks", "|").alias("links"), F.length(prose).cast("long").alias("n_chars"))
