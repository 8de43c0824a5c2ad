"""Queries of the index and of limits with their DuckDB oracles; they join those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.functions import pages
from noteloom.functions import text as tx
from noteloom.operators import limits, retrieval, vault
from noteloom.plans.catalog import BM25, CALLS, NOTES, OLD, query
from noteloom.sources import virtual_vault as vv

INDEX = f"""{NOTES}, {OLD}, nn AS (SELECT * FROM notes WHERE doc_id % 3 <> 1 OR doc_id % 2 = 0),
  st AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'updated' END AS status
    FROM old o FULL JOIN nn n ON o.path = n.path),
  wr AS (SELECT path FROM st WHERE status IN ('added', 'updated')), un AS (SELECT path FROM st WHERE status = 'unchanged'), kp AS (SELECT path FROM st WHERE status IN ('unchanged', 'updated')),
  vv AS (SELECT path, model, 'old' AS v FROM old, (VALUES ('m1'), ('m2')) m(model)), fv AS (SELECT path, 'm1' AS model, 'new' || length(body) AS v FROM nn WHERE path IN (SELECT path FROM wr))"""


def index_tables(spark, d):
    """The index as it was and as the collection is now: some notes gone, some new, some changed."""
    n = vv.notes(spark, d)
    k = F.col("doc_id")
    old_hash = F.when(k % 11 == 0, F.lit("0" * 16)).otherwise(F.col("content_hash"))
    was = n.where("doc_id % 5 <> 0").select("path", old_hash.alias("content_hash")).unionByName(n.where("doc_id % 13 = 0").select(F.concat("path", F.lit(".old")).alias("path"), "content_hash"))
    now = n.where("doc_id % 3 <> 1 or doc_id % 2 = 0")
    old = {
        "notes": was.withColumn("created_at", F.lit(1)), "tags": was.select("path", F.lit("was").alias("tag")), "front": was.select("path", F.lit("k").alias("key"), F.lit("was").alias("value")),
        "links": was.select(F.col("path").alias("source_path"), F.lit("Was").alias("target_title")),
        "vectors": was.select("path", F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("model")).withColumn("vector", F.array(F.lit(0.5))),
    }
    new = {
        "notes": now.select("path", "content_hash").withColumn("created_at", F.lit(2)), "tags": now.select("path", F.explode("tags").alias("tag")),
        "front": now.select("path", F.lit("k").alias("key"), k.cast("string").alias("value")), "links": now.select(F.col("path").alias("source_path"), F.concat(F.lit("Note "), (k + 1).cast("string")).alias("target_title")),
    }
    size = F.length("body").cast("double")
    fresh = now.select("path", F.lit("m1").alias("model"), F.posexplode(F.array(F.array(F.lit(-1.0)), F.array(size))).alias("ord", "vector"))
    return old, new, fresh


@query(f"""WITH {INDEX} SELECT 'notes' AS kind, path, CASE WHEN path IN (SELECT path FROM old) THEN 1 ELSE 2 END || ':' || content_hash AS value FROM nn
  UNION ALL SELECT 'tags', path, 'was' FROM old WHERE path IN (SELECT path FROM un) UNION ALL SELECT 'tags', path, unnest(tags) FROM nn WHERE path IN (SELECT path FROM wr)
  UNION ALL SELECT 'front', path, 'k=was' FROM old WHERE path IN (SELECT path FROM un) UNION ALL SELECT 'front', path, 'k=' || doc_id FROM nn WHERE path IN (SELECT path FROM wr)
  UNION ALL SELECT 'links', path, 'Was' FROM old WHERE path IN (SELECT path FROM un) UNION ALL SELECT 'links', path, 'Note ' || (doc_id + 1) FROM nn WHERE path IN (SELECT path FROM wr)
  UNION ALL SELECT 'vectors', path, model || ':' || v FROM vv WHERE path IN (SELECT path FROM kp) AND NOT (model = 'm1' AND path IN (SELECT path FROM wr)) UNION ALL SELECT 'vectors', path, model || ':' || v FROM fv""")
def cascade_sync(spark, d):
    """Every row of every table of the index after a pass over the collection."""
    out, _ = vault.synced(*index_tables(spark, d))
    vector = F.get("vector", F.lit(0))
    shown = F.when(vector == 0.5, "old").otherwise(F.concat(F.lit("new"), vector.cast("long").cast("string")))
    values = {
        "notes": F.concat_ws(":", F.col("created_at").cast("string"), "content_hash"), "tags": F.col("tag"), "front": F.concat_ws("=", "key", "value"),
        "links": F.col("target_title"), "vectors": F.concat_ws(":", "model", shown),
    }
    parts = [out[name].select(F.lit(name).alias("kind"), F.col(vault.CHILDREN[name]).alias("path"), value.alias("value")) for name, value in values.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(f"WITH {INDEX} SELECT count(*) FILTER (status <> 'removed') AS scanned, count(*) FILTER (status IN ('added', 'updated')) AS updated, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed FROM st")
def cascade_counts(spark, d):
    return vault.synced(*index_tables(spark, d))[1]


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0)
  SELECT 'n' || vec_id AS path, 'a' AS model, list_sum(e) AS total, len(e) AS size FROM v WHERE vec_id % 4 <> 1 UNION ALL SELECT 'n' || vec_id, 'b', 2 * e[1], 1 FROM v WHERE vec_id % 3 = 0 OR vec_id % 4 = 1""")
def keyed_vectors(spark, d):
    """Vectors of two models, written over one another, through JSON and back."""
    e = vv.read(spark, d, "embeddings").where("size(embedding) > 0").select("vec_id", F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("path"), F.col("embedding").cast("array<double>").alias("vector"))
    double = F.array(F.get("vector", F.lit(0)) * 2)
    table = e.where("vec_id % 4 <> 1").select("path", F.lit("a").alias("model"), "vector").unionByName(e.where("vec_id % 3 = 0").select("path", F.lit("b").alias("model"), F.array(F.lit(0.0)).alias("vector")))
    fresh = e.where("vec_id % 3 = 0 or vec_id % 4 = 1").select("path", F.lit("b").alias("model"), "vector", F.lit(0).alias("ord"))
    fresh = fresh.unionByName(fresh.select("path", "model", double.alias("vector"), F.lit(1).alias("ord")))
    out = vault.from_vector_json(vault.vector_json(vault.put_vectors(table, fresh)))
    return out.select("path", "model", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("vector").cast("long").alias("size"))


@query(f"""{BM25.replace("benchmark", "asked").replace("WITH ", "WITH asked AS (SELECT conv_id AS item_id, 'Plan ' || conv_id || ' ' || string_agg(substr(text, 1, 40), ' ' ORDER BY turn) AS text FROM conversations WHERE turn < 2 AND conv_id % 5 = 0 GROUP BY conv_id), ", 1)},
  vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  c AS (SELECT r.query_id, r.path, r.rank AS bmrank, r.score AS bm, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN list_cosine_similarity(a.v, b.v) END AS cos
    FROM r JOIN notes n ON n.path = r.path LEFT JOIN vec a ON a.vec_id = query_id AND query_id % 2 = 0 LEFT JOIN vec b ON b.vec_id = n.doc_id WHERE rank <= 3),
  hy AS (SELECT *, round(CASE WHEN cos IS NULL THEN bm ELSE 0.4::DOUBLE * least(bm / 10, 1) + 0.6::DOUBLE * cos END, 6) AS mixed FROM c),
  b AS (SELECT * FROM hy QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mixed DESC, bmrank) = 1),
  k AS (SELECT *, CASE WHEN mixed >= 0.6::DOUBLE THEN 'duplicate' WHEN mixed >= 0.3::DOUBLE THEN 'ambiguous' ELSE 'distinct' END AS class FROM b),
  a AS (SELECT *, class = 'duplicate' OR (class = 'ambiguous' AND query_id % 3 < 2) AS up FROM k)
  SELECT query_id AS note_id, mixed AS score, class, CASE WHEN up THEN 'update' ELSE 'create' END AS action, CASE WHEN up THEN path END AS existing_path, NOT up AS needs_folder FROM a""")
def plan_resolution(spark, d):
    """Planned notes against the index: the best note of each, its class, the verdict on ambiguous ones, the path to update."""
    n = vv.notes(spark, d)
    text = n.select("path", F.concat_ws(" ", "title", tx.summary(F.col("body")), F.array_join("tags", " ")).alias("text"))
    c = vv.read(spark, d, "conversations").where("turn < 2 and conv_id % 5 = 0")
    plans = c.groupBy(F.col("conv_id").alias("note_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.left("text", F.lit(40)).alias("h")))).alias("l"))
    plans = plans.select("note_id", F.concat(F.lit("Plan "), F.col("note_id").cast("string")).alias("title"), F.transform("l", lambda x: x["h"]).alias("headings"))
    e = vv.read(spark, d, "embeddings")
    mine = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    theirs = e.join(n.select(F.col("doc_id").alias("vec_id"), "path"), "vec_id").select("path", F.col("embedding").alias("vector"))
    hits = retrieval.searched(text, retrieval.plan_queries(plans), 1, theirs, mine)
    verdict = F.get(F.array(F.lit("reuse"), F.lit("extend"), F.lit("distinct")), (F.col("note_id") % 3).cast("int"))
    return retrieval.resolved_plans(plans, hits, plans.select("note_id", verdict.alias("verdict")), 0.6, 0.3)


def limit_sql(mode: str) -> str:
    """Refusals of each role one after the other, then every call against the last one before it."""
    share = "CASE WHEN gap >= 14400 THEN 1 ELSE gap / 14400.0::DOUBLE END" if mode == "linear" else "CASE WHEN gap >= 14400 THEN 1.0::DOUBLE ELSE 0 END"
    return f"""WITH RECURSIVE {CALLS}, h AS (SELECT role, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS sec, row_number() OVER (PARTITION BY role ORDER BY ts, event_id) AS r FROM calls WHERE k % 3 = 0),
  s AS (SELECT role, sec, r, 0.8::DOUBLE AS m FROM h WHERE r = 1
    UNION ALL SELECT role, sec, r, greatest((m + (1 - m) * {share}) * 0.8::DOUBLE, 0.5::DOUBLE) FROM (SELECT h.role, h.sec, h.r, s.m, h.sec - s.sec AS gap FROM s JOIN h ON h.role = s.role AND h.r = s.r + 1)),
  o AS (SELECT event_id, role, epoch_us(ts) / 1000000.0::DOUBLE AS sec, count(*) FILTER (k % 3 = 0) OVER (PARTITION BY role ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM calls),
  g AS (SELECT o.event_id, o.role, s.m, o.sec - s.sec AS gap FROM o LEFT JOIN s ON s.role = o.role AND s.r = o.r),
  f AS (SELECT event_id, role, CASE WHEN m IS NULL THEN 1 ELSE m + (1 - m) * {share} END AS margin FROM g)
  SELECT event_id, role, round(margin, 6) AS margin, CAST(greatest(floor(margin * 8000 + 0.000001::DOUBLE), 1) AS BIGINT) AS token_limit FROM f"""


def limits_in(spark, d, mode):
    calls = vv.calls(spark, d).select("role", "ts", "event_id", (F.col("k") % 3 == 0).alias("hit"))
    return limits.in_force(calls, 8000, recovery=14400.0, mode=mode).select("event_id", "role", F.round("margin", 6).alias("margin"), "token_limit")


@query(limit_sql("linear"))
def limit_linear(spark, d):
    return limits_in(spark, d, "linear")


@query(limit_sql("step"))
def limit_step(spark, d):
    return limits_in(spark, d, "step")


@query()
def extracted_pages(spark, d):
    """The running text of every page, or why there is none; hand-made pages and the table's own are tested."""
    p = vv.read(spark, d, "pages").select("page_id", pages.extracted(F.col("html")).alias("p"))
    return p.select("page_id", "p.text", F.when(F.col("p").isNull(), "fetch_error: no page").otherwise(F.col("p.error")).alias("error"))
