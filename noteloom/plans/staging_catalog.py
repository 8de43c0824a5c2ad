"""Queries of changesets with their DuckDB oracles; they join those of ``catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from noteloom.operators import commit as cm
from noteloom.operators import planning, web
from noteloom.operators import staging as st
from noteloom.operators.assembly import HUMANITIES
from noteloom.plans.catalog import NOTES, query
from noteloom.session import ensure_checkpoint_dir
from noteloom.sources import changesets as cs
from noteloom.sources import virtual_vault as vv

TASK = 25


def sql_text(code: str, *values: str) -> str:
    """The wording of a code as a SQL expression."""
    text = "'" + st.MESSAGES[code][1].replace("'", "''") + "'"
    for k, value in enumerate(values):
        text = text.replace("{%d}" % k, f"' || {value} || '")
    return text


def changes(spark, d):
    """Drafts of 25 documents a task: paths shared or taken, missing, dashed and known links, odd front matter, texts of many kinds."""
    k, n = F.col("doc_id"), vv.notes(spark, d).withColumn("body", F.coalesce("body", F.lit("")))
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    body = (
        F.when(k % 10 == 0, "").when(k % 10 == 1, F.left("body", F.lit(30))).when(k % 4 == 0, F.concat("body", F.lit("\n```")))
        .when(k % 6 == 1, F.concat(F.lit("## Plan a\n\n"), "body")).when(k % 12 == 5, F.concat("body", F.repeat(F.lit(" слово"), 200))).otherwise(F.col("body"))
    )
    front = F.when(k % 8 == 1, '{"title": "x", "extra": {"a": 1}}').when(k % 8 == 2, '{"tags": ["a", {"b": 1}, [2]], "n": null}').otherwise('{"title": "x", "n": 1.5, "l": ["{}", true]}')
    links = F.array_compact(F.array(text("Note ", k + 1), F.when(k % 7 == 0, text("Missing ", k)), F.when(k % 5 == 0, text("Dash–", k + 1))))
    return n.select(
        F.floor(k / TASK).cast("long").alias("task_id"), k.cast("string").alias("draft_id"), k.alias("ord"), F.when(k % 3 == 0, "update").otherwise("create").alias("action"),
        F.when(k % 9 == 0, "shared.md").when(k % 11 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(k % 31 == 0, " ").when(k % 5 == 1, text("Dash-", k)).otherwise(F.col("title")).alias("title"), text("n", k).alias("note_id"), front.alias("frontmatter"),
        F.when(k % 3 == 0, "").otherwise(body).alias("body_md"), F.when(k % 3 == 0, body).alias("append_section"), links.alias("links_out"), (k % 20 == 4).alias("is_moc"),
    )


def changed_vault(spark, d):
    return vv.notes(spark, d).where("doc_id % 2 = 0").select("path", "title")


CHANGES = f"""{NOTES}, k0 AS (SELECT doc_id AS k, coalesce(body, '') AS b0, path AS p0, title AS t0 FROM notes),
  ch AS (SELECT k, CAST(floor(k / {TASK}) AS BIGINT) AS task_id, CAST(k AS VARCHAR) AS draft_id, k % 3 = 0 AS late,
    CASE WHEN k % 9 = 0 THEN 'shared.md' WHEN k % 11 = 0 THEN 'new/' || p0 ELSE p0 END AS path,
    CASE WHEN k % 31 = 0 THEN ' ' WHEN k % 5 = 1 THEN 'Dash-' || k ELSE t0 END AS title,
    CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 = 1 THEN substr(b0, 1, 30) WHEN k % 4 = 0 THEN b0 || chr(10) || '```' WHEN k % 6 = 1 THEN '## Plan a' || chr(10) || chr(10) || b0
      WHEN k % 12 = 5 THEN b0 || repeat(' слово', 200) ELSE b0 END AS body,
    k % 10 > 1 AND k % 4 = 0 AS open, k % 10 > 1 AND k % 4 <> 0 AND k % 6 = 1 AS planned, k % 10 > 1 AND k % 4 <> 0 AND k % 6 <> 1 AND k % 12 = 5 AS own FROM k0),
  ex AS (SELECT path, title, regexp_extract(path, '([^/]*)[.]md$', 1) AS stem FROM notes WHERE doc_id % 2 = 0),
  ln AS (SELECT ch.*, pos, link FROM ch, LATERAL (SELECT row_number() OVER (ORDER BY o) AS pos, link FROM
    (SELECT 0 AS o, 'Note ' || (k + 1) AS link UNION ALL SELECT 1, 'Missing ' || k WHERE k % 7 = 0 UNION ALL SELECT 2, 'Dash–' || (k + 1) WHERE k % 5 = 0))),
  names AS (SELECT task_id, title AS name FROM ch UNION SELECT task_id, regexp_extract(path, '([^/]*)[.]md$', 1) FROM ch),
  lost AS (SELECT ln.*, (SELECT min(name) FROM names n WHERE n.task_id = ln.task_id AND n.name = replace(ln.link, '–', '-')) AS near FROM ln
    WHERE link NOT IN (SELECT title FROM ex) AND link NOT IN (SELECT stem FROM ex) AND NOT EXISTS (SELECT 1 FROM names n WHERE n.task_id = ln.task_id AND n.name = ln.link)),
  tx AS (SELECT *, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '\\n```$', ''), '\\n[ \\t]*\\n'), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13))),
      lambda x: length(x) >= 40 AND NOT starts_with(x, '>'))) + open::INT AS blocks, length(regexp_replace(regexp_replace(regexp_replace(body, '\\$\\$.*?\\$\\$', ' ', 'gs'), '\\$[^$\\n]+\\$', ' ', 'g'), '[^a-zA-Z]', '', 'g')) AS az FROM ch),
  ish AS (SELECT task_id, 1 AS phase, 0 AS late, 0 AS ord, 0 AS part, 0 AS pos, 'delete_not_allowed' AS code, {sql_text("delete_not_allowed", "count(*)")} AS message, NULL AS draft_id
      FROM ch WHERE k % 50 = 7 GROUP BY task_id
    UNION ALL SELECT task_id, 2, late::INT, k, 0, 0, 'create_collides_with_existing', {sql_text("create_collides_with_existing", "path")}, draft_id FROM ch WHERE NOT late AND path IN (SELECT path FROM ex)
    UNION ALL SELECT task_id, 2, late::INT, k, 0, 1, 'update_missing_target', {sql_text("update_missing_target", "path")}, draft_id FROM ch WHERE late AND path NOT IN (SELECT path FROM ex)
    UNION ALL SELECT task_id, 2, late::INT, k, 0, 2, 'duplicate_path_in_changeset', {sql_text("duplicate_path_in_changeset", "path")}, draft_id
      FROM (SELECT *, row_number() OVER (PARTITION BY task_id, path ORDER BY late, k) AS r FROM ch) WHERE r > 1
    UNION ALL SELECT task_id, 3, late::INT, k, 0, pos, 'wikilink_dash_variant_mismatch', {sql_text("wikilink_dash_variant_mismatch", "title", "link", "near")}, draft_id FROM lost WHERE near IS NOT NULL
    UNION ALL SELECT task_id, 3, late::INT, k, 0, pos, 'broken_wikilink', {sql_text("broken_wikilink", "title", "link")}, draft_id FROM lost WHERE near IS NULL
    UNION ALL SELECT task_id, 4, late::INT, k, 0, 0, 'yaml_unsupported_type', {sql_text("yaml_unsupported_type", "'extra'", f"'{st.WHOLE}'", "'<class ''dict''>'")}, draft_id FROM ch WHERE k % 8 = 1
    UNION ALL SELECT task_id, 4, late::INT, k, 0, p, 'yaml_unsupported_type', {sql_text("yaml_unsupported_type", "'tags'", f"'{st.IN_LIST}'", "t")}, draft_id
      FROM ch, (VALUES (1, '<class ''dict''>'), (2, '<class ''list''>')) v(p, t) WHERE k % 8 = 2
    UNION ALL SELECT task_id, 4, late::INT, k, 0, 9, 'empty_title', {sql_text("empty_title")}, draft_id FROM ch WHERE k % 31 = 0
    UNION ALL SELECT task_id, 4, late::INT, k, 1, 0, 'empty_body', {sql_text("empty_body")}, draft_id FROM ch WHERE body = '' OR (NOT late AND trim(body, ' ' || chr(10)) = '')
    UNION ALL SELECT task_id, 4, late::INT, k, 1, 1, 'unbalanced_code_fence', {sql_text("unbalanced_code_fence")}, draft_id FROM ch WHERE open
    UNION ALL SELECT task_id, 4, late::INT, k, 1, 2, 'very_short_note', {sql_text("very_short_note")}, draft_id FROM ch WHERE length(body) < 40 AND body <> '' AND (late OR trim(body, ' ' || chr(10)) <> '')
    UNION ALL SELECT task_id, 4, late::INT, k, 1, 3, 'note_too_short_structural', {sql_text("note_too_short_structural", "blocks")}, draft_id
      FROM tx WHERE NOT late AND k % 20 <> 4 AND length(body) >= 40 AND blocks < 3
    UNION ALL SELECT task_id, 4, late::INT, k, 1, 4, 'note_language_mismatch', {sql_text("note_language_mismatch", "share")}, draft_id
      FROM (SELECT *, CASE WHEN own THEN 1000 ELSE 0 END / (CASE WHEN own THEN 1000 ELSE 0 END + az)::DOUBLE AS s, CAST(round_even(s * 100, 0) AS BIGINT) AS share FROM tx
        WHERE CASE WHEN own THEN 1000 ELSE 0 END + az >= 200) WHERE s < 0.3::DOUBLE
    UNION ALL SELECT task_id, 4, late::INT, k, 2, CASE h WHEN 'Plan a' THEN 0 ELSE 1 END, 'missing_outline_heading', {sql_text("missing_outline_heading", "h", "title")}, draft_id
      FROM ch, (VALUES ('Plan a'), ('Plan b')) v(h) WHERE k % 2 = 0 AND NOT (planned AND h = 'Plan a')),
  issues AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY phase, late, ord, part, pos) AS seq,
    CASE WHEN code IN ('delete_not_allowed', 'create_collides_with_existing', 'update_missing_target', 'duplicate_path_in_changeset', 'yaml_unsupported_type', 'empty_title', 'empty_body', 'unbalanced_code_fence')
      THEN 'error' ELSE 'warning' END AS level, code, message, draft_id FROM ish)"""


def change_deletes(spark, d):
    return changes(spark, d).where("ord % 50 = 7").select("task_id", "path")


@query(f"WITH {CHANGES} SELECT task_id, seq, level, code, message, draft_id FROM issues")
def validation_run(spark, d):
    """All issues of every task, in order."""
    rows = changes(spark, d)
    heads = rows.where("ord % 2 = 0").select("note_id", F.posexplode(F.array(F.lit("Plan a"), F.lit("Plan b"))).alias("pos", "heading"))
    return st.run_validation(rows, changed_vault(spark, d), change_deletes(spark, d), False, heads)


@query(f"""WITH {CHANGES} SELECT t.task_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level = 'error') = 0 AS ok
  FROM (SELECT DISTINCT task_id FROM ch) t LEFT JOIN issues USING (task_id) GROUP BY 1""")
def validation_result(spark, d):
    return st.report(validation_run(spark, d), changes(spark, d))


RENAMED = f"""{NOTES}, dd AS (SELECT doc_id AS k, CAST(floor(doc_id / 20) AS BIGINT) AS task_id, CASE WHEN doc_id % 4 = 3 THEN 'update' ELSE 'create' END AS action,
    'Draft ' || CAST(doc_id % 3 AS VARCHAR) AS title, tags[1] AS folder FROM notes),
  dp AS (SELECT *, folder || '/' || title || '.md' AS path FROM dd),
  ex AS (SELECT DISTINCT path FROM dp WHERE k % 17 = 0), cr AS (SELECT *, row_number() OVER (PARTITION BY task_id, path ORDER BY k) AS place FROM dp WHERE action = 'create'),
  bad AS (SELECT cr.*, path IN (SELECT path FROM ex) AS there, row_number() OVER (PARTITION BY task_id, title ORDER BY k) + 1 AS n FROM cr WHERE path IN (SELECT path FROM ex) OR place > 1),
  -- titles of a task share their numbers whatever the folder, and no name here has a number of its own
  nw AS (SELECT *, title || ' (' || n || ')' AS new_title, folder || '/' || title || ' (' || n || ').md' AS new_path FROM bad),
  mv AS (SELECT task_id, title, min_by(new_title, k) AS new FROM nw WHERE there GROUP BY 1, 2),
  fx AS (SELECT d.k, d.task_id, coalesce(new_title, d.title) AS title, coalesce(new_path, d.path) AS path FROM dp d LEFT JOIN nw USING (k)),
  fl AS (SELECT fx.*, pos, link, coalesce(new, link) AS sent FROM fx, (VALUES (0, 'Draft 0'), (1, 'Draft 1'), (2, 'Other')) l(pos, link) LEFT JOIN mv ON mv.task_id = fx.task_id AND mv.title = link),
  fk AS (SELECT k, sent, min(pos) AS pos FROM fl WHERE task_id NOT IN (SELECT task_id FROM mv) OR sent <> title GROUP BY 1, 2)"""


def renamed_drafts(spark, d):
    k, n = F.col("doc_id"), vv.notes(spark, d)
    title, folder = F.concat(F.lit("Draft "), (k % 3).cast("string")), F.get("tags", F.lit(0))
    rows = n.select(
        F.floor(k / 20).cast("long").alias("task_id"), k.cast("string").alias("draft_id"), k.alias("ord"), F.when(k % 4 == 3, "update").otherwise("create").alias("action"),
        F.concat(folder, F.lit("/"), title, F.lit(".md")).alias("path"), title.alias("title"), folder.alias("folder"), F.array(F.lit("Draft 0"), F.lit("Draft 1"), F.lit("Other")).alias("links_out"),
    )
    return st.autofixed(st.completed(rows), rows.where("ord % 17 = 0").select("path").distinct())


@query(f"""WITH {RENAMED} SELECT CAST(fx.k AS VARCHAR) AS draft_id, title, path, coalesce((SELECT string_agg(sent, '|' ORDER BY pos) FROM fk WHERE fk.k = fx.k), '') AS links FROM fx""")
def autofixed_drafts(spark, d):
    """Every draft with the title, path and links that the mending of paths leaves it."""
    return renamed_drafts(spark, d)[0].select("draft_id", "title", "path", F.array_join("links_out", "|").alias("links"))


@query(f"""WITH {RENAMED} SELECT CAST(k AS VARCHAR) AS draft_id, 'path_autofixed' AS code,
  {sql_text("path_autofixed", "title", f"CASE WHEN there THEN '{st.TAKEN}' ELSE '{st.REPEATED}' END", "path", "new_title", "new_path")} AS message FROM nw""")
def autofix_issues(spark, d):
    return renamed_drafts(spark, d)[1].select("draft_id", "code", "message")


def merge_rows(spark, d):
    """Drafts in sixes; the first three of each six, where they are new, become one."""
    k, n = F.col("doc_id"), vv.notes(spark, d).where("body is not null")
    name = lambda m: F.concat(F.lit("Note "), m.cast("string"))
    body = F.concat(F.when(k % 3 == 0, HUMANITIES + "\n\n").otherwise(""), F.lit("## Part\n\n"), F.concat(F.lit("words "), F.length("body").cast("string")), F.when(k % 4 == 0, "\n```\n# code").otherwise(""))
    rows = n.select(
        F.floor(k / 6).cast("long").alias("task_id"), k.cast("string").alias("draft_id"), k.alias("ord"), F.when(k % 6 == 5, "update").otherwise("create").alias("action"), "path", "title",
        F.get("tags", F.lit(0)).alias("folder"), body.alias("body_md"), F.array(name(k + 1), name(k + 3), F.lit("Far")).alias("links_out"),
        F.array(F.get("tags", F.lit(1)), F.lit("all")).alias("tags"), F.array(F.concat(F.lit("https://s/"), (k % 2).cast("string"))).alias("source_refs"),
        F.when(k % 6 == 1, F.array(F.lit("Old"), F.lit("Older"))).otherwise(F.array().cast("array<string>")).alias("merged_from"), (k % 7 == 0).alias("needs_review"), (k % 5).alias("critic_rounds"),
    )
    small = rows.where("ord % 6 < 3")
    many = small.groupBy("task_id").agg(F.count("*").alias("n")).where("n > 1").select("task_id")
    return rows, small.join(many, "task_id", "left_semi").select("task_id", F.lit(0).alias("g"), "draft_id")


MERGE = f"""{NOTES}, r AS (SELECT doc_id AS k, CAST(floor(doc_id / 6) AS BIGINT) AS task_id, path, title, tags, tags[1] AS folder, length(body) AS n FROM notes WHERE body IS NOT NULL),
  s AS (SELECT *, k % 6 < 3 AND count(*) FILTER (k % 6 < 3) OVER (PARTITION BY task_id) > 1 AS inside FROM r),
  m AS (SELECT task_id, min(k) AS k, string_agg(title, ' + ' ORDER BY k) AS title, min_by(folder, k) AS folder, string_agg(CASE WHEN k % 6 = 1 THEN 'Old|Older' ELSE title END, '|' ORDER BY k) AS merged_from,
      CASE WHEN bool_or(k % 3 = 0) THEN '{HUMANITIES}' || chr(10) || chr(10) ELSE '' END || string_agg('## ' || title || chr(10) || chr(10) || '### Part' || chr(10) || chr(10) || 'words ' || n
        || CASE WHEN k % 4 = 0 THEN chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' ELSE '' END, chr(10) || chr(10) ORDER BY k) AS body,
      bool_or(k % 7 = 0) AS needs_review, max(k % 5) AS critic_rounds FROM s WHERE inside GROUP BY task_id),
  tg AS (SELECT task_id, t, min(p) AS p FROM (SELECT task_id, tags[2] AS t, 2 * k AS p FROM s WHERE inside UNION ALL SELECT task_id, 'all', 2 * k + 1 FROM s WHERE inside) GROUP BY 1, 2),
  sr AS (SELECT task_id, t, min(k) AS p FROM (SELECT task_id, 'https://s/' || k % 2 AS t, k FROM s WHERE inside) GROUP BY 1, 2),
  al AS (SELECT task_id, k, title, folder || '/' || title || '.md' AS path, body, merged_from, needs_review, critic_rounds, true AS made FROM m
    UNION ALL SELECT task_id, k, title, path, CASE WHEN k % 3 = 0 THEN '{HUMANITIES}' || chr(10) || chr(10) ELSE '' END || '## Part' || chr(10) || chr(10) || 'words ' || n
      || CASE WHEN k % 4 = 0 THEN chr(10) || '```' || chr(10) || '# code' ELSE '' END, CASE WHEN k % 6 = 1 THEN 'Old|Older' ELSE '' END, k % 7 = 0, k % 5, false FROM s WHERE NOT inside),
  rd AS (SELECT s.task_id, CASE WHEN s.k % 6 = 1 THEN NULL ELSE s.title END AS old, m.title AS new FROM s JOIN m USING (task_id) WHERE inside),
  lk AS (SELECT al.task_id, al.k, al.title, al.made, x.k AS src, p, CASE p WHEN 0 THEN 'Note ' || (x.k + 1) WHEN 1 THEN 'Note ' || (x.k + 3) ELSE 'Far' END AS link
    FROM al JOIN s x ON x.task_id = al.task_id AND ((al.made AND x.inside) OR x.k = al.k), (VALUES (0), (1), (2)) v(p)),
  l2 AS (SELECT lk.*, coalesce(rd.new, link) AS sent FROM lk LEFT JOIN rd ON rd.task_id = lk.task_id AND rd.old = link
    WHERE NOT made OR link NOT IN (SELECT title FROM s WHERE inside AND s.task_id = lk.task_id)),
  l3 AS (SELECT task_id, k, sent, min(src * 3 + p) AS o FROM l2 WHERE sent <> title GROUP BY 1, 2, 3)"""


@query(f"""WITH {MERGE} SELECT k AS ord, title, path, sha256(body) AS body_sha256, merged_from, needs_review, critic_rounds,
    coalesce((SELECT string_agg(sent, '|' ORDER BY o) FROM l3 WHERE l3.k = al.k AND l3.task_id = al.task_id), '') AS links,
    CASE WHEN made THEN (SELECT string_agg(t, '|' ORDER BY p) FROM tg WHERE tg.task_id = al.task_id) ELSE (SELECT tags[2] || '|all' FROM s WHERE s.k = al.k) END AS tags,
    CASE WHEN made THEN (SELECT string_agg(t, '|' ORDER BY p) FROM sr WHERE sr.task_id = al.task_id) ELSE 'https://s/' || k % 2 END AS refs FROM al""")
def merged_drafts(spark, d):
    """Drafts after merging, with all that a merged one keeps of its members."""
    out = st.merged(*merge_rows(spark, d))
    joined = {"merged_from": "merged_from", "links": "links_out", "tags": "tags", "refs": "source_refs"}
    return out.select(
        "ord", "title", "path", F.sha2("body_md", 256).alias("body_sha256"), "needs_review", "critic_rounds", *[F.array_join(c, "|").alias(name) for name, c in joined.items()]
    )


@query(f"""WITH {NOTES}, g AS (SELECT *, CAST(floor(doc_id / 10) AS BIGINT) AS task_id, doc_id % 3 <> 0 AND doc_id % 20 <> 4 AS fits FROM notes),
  i AS (SELECT task_id, count(*) AS n, string_agg('- [[' || title || ']]' || CASE doc_id % 4 WHEN 0 THEN ' — About ' || doc_id WHEN 1 THEN ' — Own words.' ELSE '' END, chr(10) ORDER BY doc_id) AS items FROM g WHERE fits GROUP BY 1)
  SELECT task_id, 'Topic ' || task_id || ' — обзор' || CASE WHEN task_id % 3 = 0 THEN ' (2)' WHEN task_id % 3 = 1 THEN ' (3)' ELSE '' END AS title,
    CASE WHEN task_id % 2 = 0 THEN '> [!abstract] Кратко' || chr(10) || '> Sum' || chr(10) || '> up' || chr(10) || chr(10) ELSE '' END || '## Заметки' || chr(10) || chr(10) || items AS body FROM i WHERE n > 1""")
def content_maps(spark, d):
    """Maps of tasks of ten notes; the vault has the first title of some, the vault and the task the first two of others."""
    k, n = F.col("doc_id"), vv.notes(spark, d)
    rows = n.select(
        F.floor(k / 10).cast("long").alias("task_id"), k.cast("string").alias("draft_id"), k.alias("ord"), F.when(k % 3 == 0, "update").otherwise("create").alias("action"), "path", "title",
        k.cast("string").alias("note_id"), F.when(k % 4 == 1, "# H\n\nOwn words. More.").otherwise("").alias("body_md"), (k % 20 == 4).alias("is_moc"),
    )
    tasks = rows.groupBy("task_id").agg((F.max("ord") + 1).alias("ord"))
    base = F.concat(F.lit("Topic "), F.col("task_id").cast("string"), F.lit(" — обзор"))
    second = tasks.where("task_id % 3 = 1").select(
        "task_id", F.lit("extra").alias("draft_id"), "ord", F.lit("update").alias("action"), F.lit("any.md").alias("path"), F.concat(base, F.lit(" (2)")).alias("title"),
        F.lit("").alias("note_id"), F.lit("").alias("body_md"), F.lit(False).alias("is_moc"),
    )
    topics = tasks.select("task_id", F.concat(F.lit(" Topic "), F.col("task_id").cast("string")).alias("topic"), F.when(F.col("task_id") % 2 == 0, "Sum\nup\n").alias("summary"), F.lit("maps").alias("folder"), F.lit("x").alias("domain"))
    abstracts = rows.where("ord % 4 = 0").select("note_id", F.concat(F.lit("About\n "), "note_id").alias("abstract"))
    taken = tasks.where("task_id % 3 < 2").select(F.concat(F.lit("maps/"), base, F.lit(".md")).alias("path"))
    return st.content_map(rows.unionByName(second), topics, abstracts, taken).select("task_id", "title", F.col("body_md").alias("body"))


@query(f"""WITH {CHANGES}, t AS (SELECT DISTINCT task_id FROM ch), dl AS (SELECT task_id, path FROM ch WHERE k % 50 = 7)
  SELECT task_id, 0 AS section, -1 AS ord, 'Задача: ' || task_id AS lines FROM t
  UNION ALL SELECT task_id, 3, -1, '⚠️  УДАЛЕНИЯ (' || count(*) || ') — по умолчанию заблокированы:' FROM dl GROUP BY 1
  UNION ALL SELECT task_id, 3, row_number() OVER (PARTITION BY task_id ORDER BY path) - 1, '  - ' || path FROM dl
  UNION ALL SELECT task_id, 4, -1, 'Новые связи (wikilinks): ' || count(*) FROM ln GROUP BY 1
  UNION ALL SELECT t.task_id, 5, -1, 'Валидация: ' || CASE WHEN count(*) FILTER (level = 'error') = 0 THEN 'OK' ELSE 'ЕСТЬ ОШИБКИ' END || ' (errors=' || count(*) FILTER (level = 'error')
    || ', warnings=' || count(*) FILTER (level = 'warning') || ')' FROM t LEFT JOIN issues USING (task_id) GROUP BY 1
  UNION ALL SELECT task_id, 5, seq, '  ' || CASE level WHEN 'error' THEN '❌' ELSE '⚠️' END || ' [' || code || '] ' || message FROM issues""")
def change_reports(spark, d):
    """What is told of a task besides its drafts, which ``change_summary`` has."""
    rows = changes(spark, d)
    out = st.change_report(rows, change_deletes(spark, d), rows.select("task_id", F.explode("links_out")).select("task_id"), validation_run(spark, d))
    return out.where("section not in (1, 2)")


CONFLICTS = f"""{NOTES}, v AS (SELECT path FROM notes WHERE doc_id % 2 = 0), c AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'shared.md' ELSE path END AS path, doc_id % 3 = 0 AS late FROM notes),
  b AS (SELECT path, count(*) FILTER (NOT late) AS creates, count(*) FILTER (late) AS updates, path IN (SELECT path FROM v) AS there FROM c GROUP BY path)"""


@query(f"""WITH {CONFLICTS} SELECT path, 'create_collides_with_existing' AS problem FROM b WHERE creates > 0 AND there UNION ALL SELECT path, 'duplicate_path_in_changeset' FROM b WHERE creates > 1
  UNION ALL SELECT path, 'update_missing_target' FROM b WHERE updates > 0 AND creates = 0 AND NOT there UNION ALL SELECT path, 'delete_not_allowed' FROM notes WHERE doc_id % 40 = 0""")
def commit_conflicts(spark, d):
    n = vv.notes(spark, d)
    rows = n.select(F.when(F.col("doc_id") % 9 == 0, "shared.md").otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 3 == 0, "update").otherwise("create").alias("action"))
    return cm.conflicts(n.where("doc_id % 2 = 0"), rows, n.where("doc_id % 40 = 0").select("path"))


@query(f"""WITH {NOTES}, o AS (SELECT * FROM notes WHERE body IS NOT NULL),
  a AS (SELECT doc_id, path, CASE WHEN doc_id % 2 = 1 THEN '---' || chr(10) || 'title: ' || title || chr(10) || 'tags:' || chr(10) || '- ' || tags[1] || chr(10) || 'created: ''2024-01-02''' || chr(10) || '---' || chr(10) || chr(10)
      || 'New ' || length(body) || chr(10) || chr(10) || '## Связанные заметки' || chr(10) || chr(10) || '- [[Note ' || (doc_id + 1) || ']]' || chr(10)
    WHEN doc_id % 6 = 0 THEN '#kept Old ' || length(body) || chr(10) || chr(10) || 'One [[x]]' || chr(10) || chr(10) || 'two' || chr(10) ELSE '#kept Old ' || length(body) END AS content FROM o WHERE doc_id % 10 <> 4)
  SELECT path, sha256(content) AS sha256, CASE WHEN doc_id % 2 = 1 THEN (SELECT tags[1] FROM o WHERE o.doc_id = a.doc_id) ELSE 'kept' END AS tags,
    CASE WHEN doc_id % 2 = 1 THEN 'Note ' || (doc_id + 1) WHEN doc_id % 6 = 0 THEN 'x' ELSE '' END AS links, doc_id % 6 = 0 AND doc_id % 2 = 0 AS saved FROM a""")
def committed_version(spark, d):
    """A collection written as a version, a changeset committed to it, and what its newest tables then hold."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/notes-{uuid.uuid4().hex}"
    n, k = vv.notes(spark, d).where("body is not null"), F.col("doc_id")
    size = F.length("body").cast("string")
    cm.created(spark, root, n.where("doc_id % 2 = 0").select("path", F.concat(F.lit("#kept Old "), size).alias("content")))
    new = n.where("doc_id % 2 = 1").select(
        F.lit(1).alias("task_id"), k.cast("string").alias("draft_id"), k.alias("ord"), F.lit("create").alias("action"), "path", "title", F.concat(F.lit("New "), size).alias("body_md"),
        F.lit(None).cast("string").alias("append_section"), F.slice("tags", 1, 1).alias("tags"), F.array(F.concat(F.lit("Note "), (k + 1).cast("string"))).alias("links_out"), F.lit("2024-01-02").alias("created"),
    )
    none = F.array().cast("array<string>")
    more = n.where("doc_id % 6 = 0").select("doc_id", "path", "title", F.posexplode(F.array(F.lit(" One [[[[x]]]]\n"), F.lit("two"))).alias("at", "s")).select(
        F.lit(1).alias("task_id"), F.concat_ws("-", "doc_id", "at").alias("draft_id"), (k * 2 + F.col("at")).alias("ord"), F.lit("update").alias("action"), "path", "title",
        F.lit("").alias("body_md"), F.col("s").alias("append_section"), none.alias("tags"), none.alias("links_out"), F.lit("").alias("created"),
    )
    cm.committed(spark, root, new.unionByName(more), n.where("doc_id % 10 = 4").select("path"), True, True)
    now = cm.current(spark, root)
    listed = lambda t, key, value, name: now[t].groupBy(F.col(key).alias("path")).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias(name))
    out = now["notes"].join(listed("tags", "path", "tag", "tags"), "path", "left").join(listed("links", "source_path", "target_title", "links"), "path", "left")
    out = out.join(now["backups"].select("path", F.lit(True).alias("saved")), "path", "left")
    return out.select("path", F.sha2("content", 256).alias("sha256"), F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("links", F.lit("")).alias("links"), F.coalesce("saved", F.lit(False)).alias("saved"))


@query(f"""WITH {CHANGES}, t AS (SELECT DISTINCT task_id FROM ch)
  SELECT CAST(t.task_id AS VARCHAR) AS task_id, (SELECT count(*) FROM ch WHERE ch.task_id = t.task_id) AS n_drafts, (SELECT sha256(string_agg(title || chr(10) || path, chr(10) ORDER BY k)) FROM ch WHERE ch.task_id = t.task_id) AS drafts_sha256,
    (SELECT count(*) FROM ch WHERE ch.task_id = t.task_id AND k % 50 = 7) AS n_deletes, (SELECT count(*) FROM issues i WHERE i.task_id = t.task_id) AS n_issues,
    (SELECT sha256(string_agg(code || ' ' || message, chr(10) ORDER BY seq)) FROM issues i WHERE i.task_id = t.task_id) AS issues_sha256,
    NOT EXISTS (SELECT 1 FROM issues i WHERE i.task_id = t.task_id AND level = 'error') AS ok FROM t""")
def staged_changesets(spark, d):
    """Every task's changeset saved as files with previews, and read back from them."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/staging-{uuid.uuid4().hex}"
    cs.save_changesets(root, changes(spark, d), change_deletes(spark, d), validation_run(spark, d))
    sha = lambda c, f: F.sha2(F.array_join(F.transform(c, f), "\n"), 256)
    return cs.load_changesets(spark, root).select(
        "task_id", F.size("drafts").cast("long").alias("n_drafts"), sha("drafts", lambda x: F.concat(x["title"], F.lit("\n"), x["path"])).alias("drafts_sha256"),
        F.size("deletes").cast("long").alias("n_deletes"), F.size("issues").cast("long").alias("n_issues"),
        F.when(F.size("issues") > 0, sha("issues", lambda x: F.concat(x["code"], F.lit(" "), x["message"]))).alias("issues_sha256"), "ok",
    )


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS subtopic FROM pages UNION ALL
    SELECT page_id + 1000000, upper(url) || '//', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) FROM pages WHERE page_id % 2 = 0),
  u AS (SELECT * FROM p WHERE rtrim(url, '/') <> '' QUALIFY row_number() OVER (PARTITION BY subtopic, lower(rtrim(url, '/')) ORDER BY page_id) = 1)
  SELECT page_id, subtopic FROM u QUALIFY row_number() OVER (PARTITION BY subtopic ORDER BY page_id) <= 6""")
def source_candidates(spark, d):
    """Search results of each host, every second one found again under another spelling."""
    p = vv.read(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("subtopic"))
    again = p.where("page_id % 2 = 0").select((F.col("page_id") + 1_000_000).alias("page_id"), F.concat(F.upper("url"), F.lit("//")).alias("url"), "subtopic")
    return web.candidates(p.unionByName(again), "subtopic", "page_id", 3).select("page_id", "subtopic")


@query(f"""WITH {CHANGES}, t AS (SELECT task_id, count(*) FILTER (NOT late) AS creates, count(*) FILTER (late) AS updates, min(title) FILTER (k % 20 = 4 AND NOT late) AS none,
    min_by(title, k) FILTER (k % 20 = 4 AND NOT late) AS map, min_by(title, k) FILTER (NOT late) AS first FROM ch GROUP BY 1),
  r AS (SELECT task_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM issues GROUP BY 1),
  q AS (SELECT t.*, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, CASE WHEN task_id % 4 = 0 THEN repeat('query ', 12) || task_id ELSE coalesce(nullif(map, ''), nullif(first, ''), '—') END AS label
    FROM t LEFT JOIN r USING (task_id))
  SELECT task_id, CASE WHEN length(label) > 60 THEN substr(label, 1, 57) || '…' ELSE label END AS label, strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 3 HOUR + to_minutes(CAST(task_id * 7 AS BIGINT)), '%d.%m.%Y %H:%M') || ' по мск' AS created,
    creates, updates, CASE WHEN task_id % 5 = 0 THEN 'не проверялся' WHEN errors = 0 THEN 'OK (warnings=' || warnings || ')' ELSE 'ЕСТЬ ОШИБКИ (errors=' || errors || ', warnings=' || warnings || ')' END AS validation FROM q""")
def staged_tasks(spark, d):
    """The listing of staged tasks: label, time, numbers, result of validation."""
    rows = changes(spark, d)
    minutes = F.col("task_id") * 7
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + minutes * 60)
    tasks = rows.select("task_id").distinct().select("task_id", F.when(F.col("task_id") % 4 == 0, F.concat(F.repeat(F.lit("query "), 12), F.col("task_id").cast("string"))).otherwise("").alias("raw_query"), at.alias("created_at"))
    return planning.staged_listing(tasks, rows, validation_result(spark, d).where("task_id % 5 <> 0"))
