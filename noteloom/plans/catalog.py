"""All queries of the base library with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import markdown as md
from noteloom.functions import text as tx
from noteloom.operators import assembly, batching, links, planning, retrieval, usage, validation, vault, web
from noteloom.sources import virtual_vault as vv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The virtual vault in SQL.
NOTES = """notes AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path, 'Note ' || doc_id AS title,
  text AS body, substr(sha256(text), 1, 16) AS content_hash, [lang, source] AS tags FROM documents)"""
LINKS = """links AS (SELECT path AS source_path, 'Note ' || (doc_id + 1) AS target_title FROM notes
  UNION ALL SELECT path, 'Missing ' || doc_id FROM notes WHERE doc_id % 7 = 0)"""
CALLS = """calls AS (SELECT event_id, event_type AS role, ts, CAST(floor(value) AS BIGINT) AS tokens,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {NOTES}, s AS (SELECT *, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)),
    lambda x: x <> '' AND NOT starts_with(x, '#')), ' ') AS flat FROM notes)
  SELECT path, title, content_hash, CASE WHEN length(flat) <= 400 THEN flat
    ELSE regexp_replace(substr(flat, 1, 400), ' [^ ]*$', '') || '…' END AS summary FROM s""")
def note_index(spark, d):
    n = vv.notes(spark, d)
    return n.select("path", "title", "content_hash", tx.summary(F.col("body")).alias("summary"))


def old_snapshot(n: DataFrame) -> DataFrame:
    """An earlier state of the vault: every fifth note missing, every eleventh different, some that are gone."""
    old_hash = F.when(F.col("doc_id") % 11 == 0, F.lit("0" * 16)).otherwise(F.col("content_hash"))
    kept = n.where("doc_id % 5 <> 0").select("path", old_hash.alias("content_hash"))
    return kept.unionByName(n.where("doc_id % 13 = 0").select(F.concat("path", F.lit(".old")).alias("path"), "content_hash"))


OLD = """old AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN '0000000000000000' ELSE content_hash END AS content_hash
  FROM notes WHERE doc_id % 5 <> 0 UNION ALL SELECT path || '.old', content_hash FROM notes WHERE doc_id % 13 = 0)"""
STATUS = """status AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
  WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'updated' END AS status FROM old o FULL JOIN notes n ON o.path = n.path)"""


@query(f"WITH {NOTES}, {OLD}, {STATUS} SELECT path, status FROM status")
def index_sync_status(spark, d):
    n = vv.notes(spark, d)
    return vault.sync_status(old_snapshot(n), n)


@query(f"""WITH {NOTES}, {OLD}, {STATUS} SELECT count(*) FILTER (status <> 'removed') AS scanned,
  count(*) FILTER (status IN ('added', 'updated')) AS updated, count(*) FILTER (status = 'unchanged') AS unchanged,
  count(*) FILTER (status = 'removed') AS removed FROM status""")
def index_sync_stats(spark, d):
    return vault.sync_counts(index_sync_status(spark, d))


@query(f"""WITH {NOTES}, {OLD} SELECT coalesce(o.path, n.path) AS path,
  CASE WHEN n.path IS NOT NULL THEN n.content_hash ELSE o.content_hash END AS content_hash,
  CASE WHEN o.path IS NOT NULL THEN 1 ELSE 2 END AS created_at, CASE WHEN n.path IS NOT NULL THEN 2 ELSE 1 END AS updated_at
  FROM old o FULL JOIN notes n ON o.path = n.path""")
def upsert_notes(spark, d):
    n = vv.notes(spark, d)
    old = old_snapshot(n).withColumns({"created_at": F.lit(1), "updated_at": F.lit(1)})
    return vault.upsert(old, n.select("path", "content_hash").withColumns({"created_at": F.lit(2), "updated_at": F.lit(2)}))


@query(f"""WITH {NOTES}, {LINKS}, gone AS (SELECT path FROM notes WHERE doc_id % 3 = 0)
  SELECT 'tags' AS kind, count(*) AS n FROM (SELECT path, unnest(tags) FROM notes) t WHERE path NOT IN (SELECT path FROM gone)
  UNION ALL SELECT 'links', count(*) FROM links WHERE source_path NOT IN (SELECT path FROM gone)
  UNION ALL SELECT 'notes', count(*) FROM notes WHERE path NOT IN (SELECT path FROM gone)""")
def delete_cascade(spark, d):
    n = vv.notes(spark, d)
    gone = n.where("doc_id % 3 = 0").select("path")
    tags = vault.without(n.select("path", F.explode("tags").alias("tag")), gone, "path")
    out = None
    for kind, t in (("tags", tags), ("links", vault.without(vv.links(spark, d), gone, "source_path")), ("notes", vault.without(n, gone, "path"))):
        part = t.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {NOTES}, {LINKS} SELECT source_path, target_title FROM links l WHERE NOT EXISTS
  (SELECT 1 FROM notes n WHERE n.path = l.source_path AND n.doc_id % 4 = 0)
  UNION ALL SELECT path, 'Hub' FROM notes WHERE doc_id % 4 = 0""")
def replace_links(spark, d):
    fresh = vv.notes(spark, d).where("doc_id % 4 = 0").select(F.col("path").alias("source_path"), F.lit("Hub").alias("target_title"))
    return vault.replace_children(vv.links(spark, d), fresh, "source_path")


@query("""SELECT vec_id, max_by(label, ord) AS label FROM (SELECT vec_id, label, 0 AS ord FROM embeddings
  UNION ALL SELECT vec_id, label + 100, 1 FROM embeddings WHERE vec_id % 9 = 0) GROUP BY vec_id""")
def latest_embeddings(spark, d):
    e = vv.read(spark, d, "embeddings").select("vec_id", "label", F.lit(0).alias("ord"))
    again = e.where("vec_id % 9 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("ord"))
    return vault.latest(e.unionByName(again), ["vec_id"], "ord").select("vec_id", "label")


@query(f"WITH {NOTES} SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM notes WHERE contains(path, '/')")
def distinct_folders(spark, d):
    return vault.folders(vv.notes(spark, d))


@query(f"WITH {NOTES} SELECT DISTINCT unnest(tags) AS tag FROM notes")
def distinct_tags(spark, d):
    return vault.tag_list(vv.notes(spark, d))


@query(f"""WITH {NOTES}, {LINKS}, t AS (SELECT title, max(path) AS target_path FROM notes GROUP BY title)
  SELECT source_path, target_title, target_path FROM links LEFT JOIN t ON target_title = title""")
def resolve_links(spark, d):
    return links.resolve(vv.links(spark, d), vv.notes(spark, d))


@query(f"""WITH {NOTES}, {LINKS}, t AS (SELECT title, max(path) AS target_path FROM notes GROUP BY title)
  SELECT target_path, count(DISTINCT source_path) AS n_sources FROM links JOIN t ON target_title = title GROUP BY target_path""")
def backlinks(spark, d):
    return links.backlinks(resolve_links(spark, d))


@query(f"WITH {NOTES}, {LINKS} SELECT source_path, string_agg(target_title, '|' ORDER BY target_title) AS targets FROM links GROUP BY 1")
def outlinks(spark, d):
    found = vv.links(spark, d).groupBy("source_path").agg(F.array_sort(F.collect_list("target_title")).alias("t"))
    return found.select("source_path", F.array_join("t", "|").alias("targets"))


def ranked(spark, d, k=5):
    """Notes against the benchmark's items as queries: term scores of titles, summaries and tags."""
    n = vv.notes(spark, d).select("path", F.concat_ws(" ", "title", tx.summary(F.col("body")), F.array_join("tags", " ")).alias("text"))
    asked = vv.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(n, asked, k)


SUMMARY = """fl AS (SELECT *, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)),
    lambda x: x <> '' AND NOT starts_with(x, '#')), ' ') AS flat FROM notes),
  sm AS (SELECT *, CASE WHEN length(flat) <= 400 THEN flat ELSE regexp_replace(substr(flat, 1, 400), ' [^ ]*$', '') || '…' END AS summary FROM fl)"""
BM25 = f"""WITH {NOTES}, {SUMMARY}, txt AS (SELECT path, title || ' ' || summary || ' ' || array_to_string(tags, ' ') AS t FROM sm),
  tok AS (SELECT path, unnest(regexp_split_to_array(lower(translate(t, '/-', '  ')), '\\s+')) AS term FROM txt),
  tf AS (SELECT path, term, count(*) AS tf FROM tok WHERE term <> '' GROUP BY 1, 2),
  dl AS (SELECT path, sum(tf)::DOUBLE AS dl FROM tf GROUP BY 1), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
  df AS (SELECT term, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf, st GROUP BY term, n),
  m AS (SELECT avg(raw) AS mean FROM df),
  q AS (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(translate(text, '/-', '  ')), '\\s+')) AS term FROM benchmark),
  qt AS (SELECT query_id, term, count(*) AS times FROM q WHERE term <> '' GROUP BY 1, 2),
  h AS (SELECT query_id, path, round(sum(times * CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END * tf * 2.5::DOUBLE
    / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
    FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (path), st, m GROUP BY 1, 2),
  s AS (SELECT a.query_id, a.path, coalesce(h.score, 0) AS score FROM (SELECT item_id AS query_id, path FROM benchmark, notes) a LEFT JOIN h USING (query_id, path)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s)"""


@query(f"{BM25} SELECT query_id, path, score, rank FROM r WHERE rank <= 5")
def bm25_topk(spark, d):
    return ranked(spark, d)


@query(f"""{BM25.replace("benchmark", "asked").replace("WITH ", "WITH asked AS (SELECT conv_id AS item_id, text FROM conversations WHERE turn = 0), ", 1)}
  SELECT query_id, path, score, rank FROM r WHERE rank <= 3""")
def bm25_foreign_queries(spark, d):
    """First turns of all conversations as queries: many share no term with any note and get the first paths."""
    n = vv.notes(spark, d).select("path", F.concat_ws(" ", "title", tx.summary(F.col("body")), F.array_join("tags", " ")).alias("text"))
    asked = vv.read(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(n, asked, 3)


@query("""SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) <= 5""")
def cosine_topk(spark, d):
    """The rerank step over all rows."""
    e = vv.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return retrieval.nearest(e, e.where("vec_id % 50 = 0"), 5).drop("rank")


@query(f"""{BM25}, vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  c AS (SELECT query_id, r.path, r.score AS bm, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN list_cosine_similarity(a.v, b.v) END AS cos
    FROM r JOIN notes n ON n.path = r.path LEFT JOIN vec a ON a.vec_id = query_id LEFT JOIN vec b ON b.vec_id = n.doc_id WHERE rank <= 15),
  hy AS (SELECT query_id, path, round(CASE WHEN cos IS NULL THEN bm ELSE 0.4::DOUBLE * least(bm / 10, 1) + 0.6::DOUBLE * cos END, 4) AS score FROM c)
  SELECT query_id, path, score FROM hy QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) <= 5""")
def hybrid_topk(spark, d):
    first = ranked(spark, d, 15).withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long"))
    e = vv.read(spark, d, "embeddings")
    mine = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    theirs = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    both = first.join(mine, "query_id", "left").join(theirs, "doc_id", "left")
    cos = F.when(F.col("q").isNotNull() & F.col("v").isNotNull(), retrieval.cosine(F.col("q"), F.col("v")))
    scored = both.select("query_id", "path", F.round(retrieval.hybrid(F.col("score"), cos), 4).alias("score"))
    return retrieval.top(scored, 5).drop("rank")


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, q.label
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
  b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1),
  k AS (SELECT *, CASE WHEN score >= 0.85::DOUBLE THEN 'duplicate' WHEN score >= 0.55::DOUBLE THEN 'ambiguous' ELSE 'distinct' END AS class FROM b),
  a AS (SELECT *, class = 'duplicate' OR (class = 'ambiguous' AND label % 2 = 0) AS up FROM k)
  SELECT query_id, score, class, CASE WHEN up THEN 'update' ELSE 'create' END AS action, CASE WHEN up THEN vec_id END AS target_id FROM a""")
def dedup_classify(spark, d):
    best = cosine_topk(spark, d).groupBy("query_id").agg(F.min_by(F.struct("score", "vec_id"), F.struct(-F.col("score"), "vec_id")).alias("b"))
    verdicts = vv.read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") % 2 == 0, "extend").otherwise("distinct").alias("verdict"))
    kind = retrieval.similarity_class(F.col("b.score"))
    found = best.join(verdicts, "query_id").select("query_id", "b.score", kind.alias("class"), retrieval.resolution(kind, F.col("verdict")).alias("action"), "b.vec_id")
    return found.select("query_id", "score", "class", "action", F.when(F.col("action") == "update", F.col("vec_id")).alias("target_id"))


@query("""SELECT page_id, url FROM pages WHERE rtrim(url, '/') <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(rtrim(url, '/')) ORDER BY page_id) = 1""")
def url_dedup(spark, d):
    return web.unique_urls(vv.read(spark, d, "pages").select("page_id", "url"), "page_id")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS subtopic FROM pages
  QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) ORDER BY length(html) DESC, page_id) <= 4""")
def topn_per_subtopic(spark, d):
    p = vv.read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("subtopic"), F.length("html").alias("n"))
    return web.first_of_each(p, "subtopic", [F.desc("n"), "page_id"], 4).select("page_id", "subtopic")


PAGE = r"""regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<header\b.*?</header>|<footer\b.*?</footer>', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"""
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    PAGE = f"replace({PAGE}, '{_name}', '{_char}')"


@query(f"SELECT page_id, trim(regexp_replace({PAGE}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages")
def html_text(spark, d):
    p = vv.read(spark, d, "pages")
    return p.select("page_id", tx.page_text(F.col("html")).alias("text"))


@query()
def chunk_units(spark, d):
    return web.units(vv.read(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN CAST(floor(length(text) / 4.0::DOUBLE) AS BIGINT) + 1 ELSE 0 END AS tokens FROM documents")
def token_estimate(spark, d):
    return vv.read(spark, d, "documents").select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"))


def turns(spark, d):
    c = vv.read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("list_id"), F.col("turn").alias("ord"), tx.estimated_tokens(F.col("text")).alias("tokens"))


PACK = """WITH RECURSIVE i AS (SELECT conv_id AS list_id, turn AS ord, CASE WHEN length(text) > 0 THEN CAST(floor(length(text) / 4.0::DOUBLE) AS BIGINT) + 1 ELSE 0 END AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
  p AS (SELECT list_id, ord, tokens, r, 0::BIGINT AS batch, tokens AS used FROM i WHERE r = 1
    UNION ALL SELECT i.list_id, i.ord, i.tokens, i.r, CASE WHEN p.used + i.tokens > 200 THEN p.batch + 1 ELSE p.batch END,
      CASE WHEN p.used + i.tokens > 200 THEN i.tokens ELSE p.used + i.tokens END FROM p JOIN i ON i.list_id = p.list_id AND i.r = p.r + 1)"""


@query(f"{PACK} SELECT list_id, ord, tokens, batch FROM p")
def batch_pack(spark, d):
    return batching.packed(turns(spark, d), 200)


@query(f"{PACK} SELECT list_id, ord, tokens, batch, CAST(floor((row_number() OVER (PARTITION BY list_id, batch ORDER BY ord) - 1) / 2) AS BIGINT) AS part FROM p")
def batch_cap(spark, d):
    return batching.capped(batch_pack(spark, d), 2)


@query(f"""WITH {CALLS} SELECT role, date_trunc('minute', ts) AS minute, CAST(sum(tokens) AS BIGINT) AS used, count(*) AS n_calls, sum(tokens) > 60 AS over
  FROM calls GROUP BY 1, 2""")
def minute_window_usage(spark, d):
    return usage.minute_use(vv.calls(spark, d), 60)


@query(f"""WITH {CALLS}, b AS (SELECT event_id, tokens, CAST(coalesce(sum(tokens) OVER (PARTITION BY role, date_trunc('minute', ts) ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM calls)
  SELECT event_id, before, before + tokens <= 60 OR before = 0 AS fits FROM b""")
def minute_admission(spark, d):
    return usage.admitted(vv.calls(spark, d), 60).select("event_id", "before", "fits")


@query(f"""WITH {CALLS} SELECT event_id, count(*) OVER (PARTITION BY role ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS recent FROM calls""")
def rpm_sliding(spark, d):
    return usage.calls_in_last(vv.calls(spark, d)).select("event_id", "recent")


@query(f"""WITH {CALLS}, o AS (SELECT role, tokens, row_number() OVER w AS i, count(*) OVER (PARTITION BY role) AS n FROM calls WINDOW w AS (PARTITION BY role ORDER BY ts, event_id))
  SELECT role, round(sum(tokens * CASE WHEN i = 1 THEN 1 ELSE 0.3::DOUBLE END * pow(0.7::DOUBLE, n - i)), 6) AS average FROM o GROUP BY role""")
def role_ema(spark, d):
    out = usage.moving_average(vv.calls(spark, d), F.col("tokens"))
    return out.select("role", F.round("average", 6).alias("average"))


@query(f"WITH {CALLS} SELECT role, count(*) FILTER (k % 3 = 0) AS hits, count(*) AS n_calls, count(*) FILTER (k % 3 = 0) / count(*)::DOUBLE AS rate FROM calls GROUP BY role")
def cache_hit_rate(spark, d):
    return usage.hit_rate(vv.calls(spark, d), F.col("k") % 3 == 0)


@query(f"""WITH {CALLS}, s AS (SELECT event_id, greatest(pow(0.8::DOUBLE, k % 5), 0.5::DOUBLE) AS start, least(tokens / 300.0::DOUBLE, 1) AS p FROM calls)
  SELECT event_id, CAST(greatest(floor((start + (1 - start) * p) * 8000), 1) AS BIGINT) AS token_limit FROM s""")
def margin_recovery(spark, d):
    limit = usage.limit_after_hits(F.col("k") % 5, F.col("tokens"), 8000)
    return vv.calls(spark, d).select("event_id", limit.alias("token_limit"))


@query(f"WITH {CALLS}, n AS (SELECT event_id, row_number() OVER (PARTITION BY role, ts::DATE ORDER BY ts, event_id) AS number FROM calls) SELECT event_id, number, number <= 40 AS allowed FROM n")
def call_budget(spark, d):
    return usage.running_calls(vv.calls(spark, d), 40).select("event_id", "number", "allowed")


def sections(spark, d):
    c = vv.read(spark, d, "conversations").select(F.col("conv_id").alias("note_id"), F.col("turn").alias("ord"), "role", "text")
    subpoints = c.select("note_id", "ord", F.concat_ws(" ", "role", F.col("ord").cast("string")).alias("heading"))
    written = c.where("ord % 4 <> 3").select("note_id", "ord", F.col("text").alias("markdown"), (F.col("ord") % 3 == 1).alias("needs_check"), F.lit(0).alias("pos"))
    return subpoints, written


@query(r"""WITH s AS (SELECT conv_id AS note_id, turn AS ord, role || ' ' || turn AS heading,
    CASE WHEN turn % 4 <> 3 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '' END AS t, turn % 4 = 3 OR turn % 3 = 1 AS chk FROM conversations)
  SELECT note_id, string_agg('## ' || heading || CASE WHEN chk THEN chr(10) || chr(10) || '> [!warning] Требует проверки' || chr(10)
      || '> Детали этого раздела могут быть неточными.' ELSE '' END || chr(10) || chr(10) || CASE WHEN t = '' THEN '_Раздел не удалось сгенерировать автоматически — заполните его вручную._' ELSE t END,
    chr(10) || chr(10) ORDER BY ord) AS body, count(*) FILTER (chk) AS n_unverified FROM s GROUP BY note_id""")
def section_assembly(spark, d):
    return assembly.assembled(*sections(spark, d))


@query(r"""WITH c AS (SELECT conv_id - conv_id % 8 AS g, conv_id AS ord, min_by(text, turn) AS t FROM conversations GROUP BY conv_id),
  l AS (SELECT 'Topic ' || g AS topic, count(*) AS n_notes, string_agg('- [[Chat ' || ord || ']] — ' || length(t), chr(10) ORDER BY ord) AS body FROM c GROUP BY g HAVING count(*) > 1)
  SELECT topic, topic || ' — обзор' || CASE WHEN CAST(substr(topic, 7) AS BIGINT) % 3 = 0 THEN ' (2)' ELSE '' END AS title, n_notes, body FROM l""")
def moc_build(spark, d):
    """Maps of up to eight conversations each, so that their number and not their size grows with the table."""
    c = vv.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("ord")).agg(F.min_by("text", "turn").alias("t"))
    group = F.col("ord") - F.col("ord") % 8
    topic = F.concat(F.lit("Topic "), group.cast("string"))
    drafts = c.select(topic.alias("topic"), "ord", F.lit("create").alias("action"), F.concat(F.lit("Chat "), F.col("ord").cast("string")).alias("title"), F.length("t").cast("string").alias("description"))
    taken = drafts.where(group % 3 == 0).select(F.concat("topic", F.lit(" — обзор")).alias("title")).distinct()
    return assembly.overview(drafts, taken)


def drafts(spark, d):
    n = vv.notes(spark, d)
    return n.select(
        F.col("doc_id").alias("draft_id"), "title", "path", F.when(F.col("doc_id") % 3 == 0, "update").otherwise("create").alias("action"), "body",
        F.array(F.concat(F.lit("Note "), (F.col("doc_id") + 1).cast("string")), F.concat(F.lit("Note "), (F.col("doc_id") - F.col("doc_id") % 2).cast("string"))).alias("links_out"),
    )


@query(f"""WITH {NOTES}, l AS (SELECT doc_id AS draft_id, doc_id + 1 AS a, doc_id - doc_id % 2 AS b FROM notes),
  m AS (SELECT draft_id, 0 AS pos, CASE WHEN a % 4 = 1 THEN a - 1 ELSE a END AS t FROM l UNION ALL SELECT draft_id, 1, CASE WHEN b % 4 = 1 THEN b - 1 ELSE b END FROM l),
  k AS (SELECT draft_id, t, min(pos) AS pos FROM m WHERE t <> draft_id GROUP BY 1, 2)
  SELECT l.draft_id, coalesce((SELECT string_agg('Note ' || t, '|' ORDER BY pos) FROM k WHERE k.draft_id = l.draft_id), '') AS links_out FROM l""")
def merge_redirect(spark, d):
    n = vv.notes(spark, d)
    before = F.concat(F.lit("Note "), (F.col("doc_id") - 1).cast("string"))
    moved = n.select(F.explode(F.array("doc_id", F.col("doc_id") + 1)).alias("doc_id")).where("doc_id % 4 = 1").distinct()
    moved = moved.select(F.concat(F.lit("Note "), F.col("doc_id").cast("string")).alias("old"), before.alias("new"))
    return links.redirect(drafts(spark, d), moved).select("draft_id", F.array_join("links_out", "|").alias("links_out"))


@query(f"""WITH {NOTES}, t AS (SELECT *, doc_id - doc_id % 10 AS g FROM notes)
  SELECT g, string_agg(title, ' + ' ORDER BY doc_id) AS title, bool_or(doc_id % 7 = 0) AS needs_review, max(doc_id % 5) AS critic_rounds,
    array_to_string(list_sort(list_distinct(flatten(list(tags)))), '|') AS tags FROM t GROUP BY g""")
def merge_drafts(spark, d):
    n = vv.notes(spark, d)
    rows = n.select(
        (F.col("doc_id") - F.col("doc_id") % 10).alias("g"), F.col("doc_id").alias("ord"), "title", "tags", F.array(F.lit("Note 0")).alias("links_out"),
        F.col("body").alias("body_md"), (F.col("doc_id") % 7 == 0).alias("needs_review"), (F.col("doc_id") % 5).alias("critic_rounds"),
    )
    return assembly.merged(rows, "g").select("g", "title", "needs_review", "critic_rounds", F.array_join(F.array_sort("tags"), "|").alias("tags"))


@query()
def autofix_paths(spark, d):
    n = vv.notes(spark, d)
    folder = tx.folder_of(F.col("path"))
    title = F.concat(F.lit("Draft "), (F.col("doc_id") % 3).cast("string"))
    rows = n.select(
        (F.col("doc_id") / 20).cast("long").alias("task_id"), F.col("doc_id").cast("string").alias("draft_id"), F.col("doc_id").alias("ord"),
        F.lit("create").alias("action"), title.alias("title"), F.concat(folder, F.lit("/"), title, F.lit(".md")).alias("path"),
    )
    return assembly.autofixed(rows, rows.where("ord % 17 = 0").select("path").distinct())


@query(f"""WITH {NOTES}, {LINKS} SELECT source_path, target_title, 'broken_wikilink' AS code FROM links
  WHERE target_title NOT IN (SELECT title FROM notes) AND target_title NOT IN (SELECT doc_id::VARCHAR FROM notes)""")
def validate_links(spark, d):
    n = vv.notes(spark, d)
    return links.check_links(vv.links(spark, d), links.names(n, n))


PATHS = """dr AS (SELECT doc_id AS draft_id, CASE WHEN doc_id % 9 = 0 THEN 'shared.md' ELSE path END AS path, CASE WHEN doc_id % 3 = 0 THEN 'update' ELSE 'create' END AS action FROM notes),
  ex AS (SELECT path FROM notes WHERE doc_id % 2 = 0),
  iss AS (SELECT draft_id, 'create_path_exists' AS code FROM dr WHERE action = 'create' AND path IN (SELECT path FROM ex)
    UNION ALL SELECT draft_id, 'update_path_missing' FROM dr WHERE action = 'update' AND path NOT IN (SELECT path FROM ex)
    UNION ALL SELECT draft_id, 'duplicate_path_in_batch' FROM (SELECT draft_id, row_number() OVER (PARTITION BY path ORDER BY draft_id) AS r FROM dr) WHERE r > 1)"""


@query(f"WITH {NOTES}, {PATHS} SELECT draft_id, code FROM iss")
def validate_paths(spark, d):
    n = vv.notes(spark, d)
    batch = drafts(spark, d).withColumn("path", F.when(F.col("draft_id") % 9 == 0, "shared.md").otherwise(F.col("path")))
    return links.check_paths(batch.select("draft_id", "path", "action"), n.where("doc_id % 2 = 0"))


BODY = r"""bi AS (SELECT doc_id AS draft_id, body, regexp_replace(regexp_replace(regexp_replace(body, '\$\$.*?\$\$', ' ', 'gs'), '\$[^$\n]+\$', ' ', 'g'), '[^a-zA-Z]', '', 'g') AS az,
    len(list_filter(list_transform(regexp_split_to_array(body, '\n[ \t]*\n'), lambda x: trim(x, chr(32) || chr(10) || chr(9) || chr(13))), lambda x: length(x) >= 40 AND NOT starts_with(x, '>'))) AS blocks FROM notes),
  bc AS (SELECT draft_id, 'empty_body' AS code FROM bi WHERE trim(body, chr(32) || chr(10) || chr(9) || chr(13)) = ''
    UNION ALL SELECT draft_id, 'very_short_note' FROM bi WHERE length(body) < 40 AND trim(body, chr(32) || chr(10) || chr(9) || chr(13)) <> ''
    UNION ALL SELECT draft_id, 'note_too_short_structural' FROM bi WHERE length(body) >= 40 AND draft_id % 3 <> 0 AND blocks < 3
    UNION ALL SELECT draft_id, 'note_language_mismatch' FROM bi WHERE length(az) >= 200)"""


@query(f"WITH {NOTES}, {BODY} SELECT draft_id, code FROM bc")
def validate_body(spark, d):
    t = validation.letter_counts(drafts(spark, d).select("draft_id", "action", F.coalesce("body", F.lit("")).alias("body")), F.col("body"))
    return t.select("draft_id", F.explode(validation.body_codes(F.col("body"), F.col("action") == "create", F.col("own"), F.col("letters"))).alias("code"))


@query(f"""WITH {NOTES}, {PATHS}, {BODY}, al AS (SELECT code FROM iss UNION ALL SELECT code FROM bc)
  SELECT code, count(*) AS n, CASE WHEN code IN ('empty_body', 'create_path_exists', 'update_path_missing', 'duplicate_path_in_batch') THEN 'error' ELSE 'warning' END AS level FROM al GROUP BY code""")
def validation_summary(spark, d):
    return validation.summary(validate_paths(spark, d).unionByName(validate_body(spark, d)))


@query(f"""WITH {NOTES}, e AS (SELECT path AS from_note, doc_id + 1 AS t FROM notes UNION ALL SELECT path, doc_id - doc_id % 2 FROM notes)
  SELECT from_note, coalesce((SELECT max(path) FROM notes n WHERE n.doc_id = e.t), 'Note ' || t) AS to_note FROM e""")
def relationships(spark, d):
    return links.relationships(drafts(spark, d))


@query(r"""SELECT doc_id, array_to_string(['note-' || doc_id, lang || '/' || source], '|') AS tags FROM documents""")
def normalize_tags(spark, d):
    raw = F.array(F.concat(F.lit(" #Note "), F.col("doc_id").cast("string")), F.upper(F.concat_ws("/", "lang", "source")), F.lit("2024"), F.lit(""), F.concat(F.lit("note-"), F.col("doc_id").cast("string")))
    return vv.read(spark, d, "documents").select("doc_id", F.array_join(tx.normalized_tags(raw), "|").alias("tags"))


@query("SELECT doc_id, '[[Note ' || doc_id || ']] and [[' || source || ']]' AS text FROM documents")
def sanitize_links(spark, d):
    text = F.concat(F.lit("[[[[Note "), F.col("doc_id").cast("string"), F.lit("]]]] and [["), F.col("source"), F.lit("]]"))
    return vv.read(spark, d, "documents").select("doc_id", tx.collapse_brackets(text).alias("text"))


@query("SELECT doc_id, doc_id % 3 + 0.9::DOUBLE AS confidence, source FROM documents")
def repair_json(spark, d):
    raw = F.concat(F.lit('```json\n{"confidence": '), (F.col("doc_id") % 3).cast("string"), F.lit('. Nine, "source": "'), F.col("source"), F.lit('"}\n```'))
    rows = vv.read(spark, d, "documents").select("doc_id", raw.alias("raw"))
    schema = "confidence double, source string"
    parsed = F.coalesce(F.from_json("raw", schema, {"mode": "PERMISSIVE"}), F.lit(None))
    fixed = F.from_json(tx.repaired_json(F.col("raw")), schema)
    chosen = F.when(parsed["confidence"].isNotNull(), parsed).otherwise(fixed)
    return rows.select("doc_id", chosen["confidence"].alias("confidence"), chosen["source"].alias("source"))


def responses(spark, d):
    c = vv.read(spark, d, "conversations").select(F.col("conv_id").alias("batch_id"), "turn", F.length("text").cast("string").alias("payload"))
    units = c.select("batch_id", F.col("turn").alias("unit_index"))
    given = c.select("batch_id", F.col("turn").alias("pos"), (F.floor(F.col("turn") / 2) * 2).cast("long").alias("unit_index"), "payload")
    return units, given


@query("""WITH r AS (SELECT conv_id AS batch_id, CAST(floor(turn / 2) * 2 AS BIGINT) AS unit_index, min_by(length(text)::VARCHAR, turn) AS payload FROM conversations GROUP BY 1, 2)
  SELECT c.conv_id AS batch_id, c.turn AS unit_index, coalesce(payload, 'none') AS payload, payload IS NULL AS missing
  FROM conversations c LEFT JOIN r ON r.batch_id = c.conv_id AND r.unit_index = c.turn""")
def response_join_first_wins(spark, d):
    return assembly.with_responses(*responses(spark, d), F.lit("none"))


@query("""WITH r AS (SELECT conv_id AS batch_id, CAST(floor(turn / 2) * 2 AS BIGINT) AS unit_index, min_by(length(text) % 30, turn) AS f FROM conversations GROUP BY 1, 2)
  SELECT c.conv_id AS batch_id, c.turn AS unit_index, CASE WHEN 'src' || f IN (SELECT source FROM documents) THEN 'src' || f ELSE 'Inbox' END AS folder
  FROM conversations c LEFT JOIN r ON r.batch_id = c.conv_id AND r.unit_index = c.turn""")
def folder_assign(spark, d):
    units, given = responses(spark, d)
    named = given.withColumn("payload", F.concat(F.lit("src"), (F.col("payload").cast("int") % 30).cast("string")))
    valid = vv.read(spark, d, "documents").select(F.col("source").alias("folder")).distinct()
    return assembly.assigned_folders(units, named, valid, "Inbox")


@query("""SELECT conv_id AS note_id, count(*) AS n FROM conversations WHERE turn % 4 = 3 GROUP BY conv_id""")
def heading_coverage(spark, d):
    subpoints, written = sections(spark, d)
    bodies = written.groupBy("note_id").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("## "), F.col("ord").cast("string"), F.lit(".")))).alias("body"))
    plans = subpoints.select("note_id", F.concat(F.col("ord").cast("string"), F.lit(".")).alias("heading"))
    return validation.uncovered(plans, bodies).groupBy("note_id").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_replace(lower(url), '[^a-z]', '', 'g') AS slug FROM pages""")
def slugs(spark, d):
    title = F.regexp_replace(F.lower("url"), "[^a-z/]", "")
    return vv.read(spark, d, "pages").select("page_id", F.replace(tx.slug(title), F.lit(" "), F.lit("")).alias("slug"))


@query()
def inline_links(spark, d):
    """Each document's language and its first long word as titles, linked where prose first has them."""
    t = vv.read(spark, d, "documents")
    titles = F.array("lang", F.regexp_extract("text", r"([A-Za-z]{6,})", 1))
    return t.select("doc_id", md.linked(F.col("text"), titles).alias("text"))


@query("SELECT doc_id, text || ' одномерная' AS text FROM documents")
def glitch_free_text(spark, d):
    t = vv.read(spark, d, "documents")
    return t.select("doc_id", md.glitch_free(F.concat("text", F.lit(" однoмерная"))).alias("text"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 4 IN (0, 3) AND turn % 3 = 0 THEN 'definition' WHEN conv_id % 4 = 1 AND turn % 3 = 1 THEN 'context'
  WHEN conv_id % 4 = 2 AND turn % 3 = 2 THEN 'steps' ELSE 'other' END AS kind FROM conversations""")
def normalize_kinds(spark, d):
    c = vv.read(spark, d, "conversations")
    domain = F.get(F.array(*[F.lit(x) for x in (*planning.KINDS, "unknown")]), (F.col("conv_id") % 4).cast("int"))
    kind = F.get(F.array(F.lit("definition"), F.lit("context"), F.lit("steps")), (F.col("turn") % 3).cast("int"))
    return c.select("conv_id", "turn", planning.normalized_kind(domain, kind).alias("kind"))


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn AND length(x.text) % 2 = 0)")
def undone_units(spark, d):
    c = vv.read(spark, d, "conversations")
    return planning.undone(c.select("conv_id", "turn"), c.where("length(text) % 2 = 0"), ["conv_id", "turn"])


@query("SELECT user_id AS request_id, min(event_id) AS attempt FROM events WHERE value >= 20 GROUP BY user_id")
def failover(spark, d):
    e = vv.read(spark, d, "events")
    return planning.first_success(e.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("attempt"), (F.col("value") >= 20).alias("ok")))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '…' ELSE text END AS label FROM documents")
def task_listing(spark, d):
    return vv.read(spark, d, "documents").select("doc_id", planning.preview(F.col("text")).alias("label"))


@query("SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M') || ' по мск' AS shown FROM events")
def moscow_times(spark, d):
    return vv.calls(spark, d).select("event_id", planning.moscow_time(F.col("ts")).alias("shown"))


@query(f"WITH {NOTES} SELECT DISTINCT CASE WHEN doc_id % 3 <> 0 THEN title ELSE doc_id::VARCHAR END AS name FROM notes")
def linking_context(spark, d):
    return planning.link_names(drafts(spark, d))


@query("SELECT conv_id % 10 AS task_id, count(DISTINCT conv_id) AS n_notes, count(*) AS n_subpoints FROM conversations GROUP BY 1")
def plan_totals(spark, d):
    c = vv.read(spark, d, "conversations")
    return planning.totals(c.select((F.col("conv_id") % 10).alias("task_id"), F.col("conv_id").alias("note_id")))
