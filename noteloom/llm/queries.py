"""The registered queries of this subpackage, over whole tables, and their oracles."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import ann, byte_bpe, chat_format, decontamination, dual_tree, jaccard_join, language_id, packing, prefix_trie, quality_rules, secret_scan, surrogates, token_counts
from noteloom.llm.tables import table


def fold(column: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))


def op1_posting_list_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.conversation_digests(rows.unionByName(chat_format.probe_rows(rows)))


OP3_SQL = r"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), ''))
    AS loss_sha256,
  CAST(sum(17 + length(replace(regexp_replace(role, CONTROL, '\1\\\2\3', 'g'), chr(10), '<|nl|>'))
           + length(regexp_replace(text, CONTROL, '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality_rules.fit(docs, labels.where(fold("doc_id", 5) != 0))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = quality_rules.score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs.where(fold("doc_id", 3) != 1))


def op5_piece_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), op5_language_model(docs))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    counts = [
        F.size(F.filter("secrets", secret_scan.of_kind(kind))).cast("long").alias(f"n_{kind}")
        for kind in secret_scan.KINDS[:3]
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secrets")).alias("spans"),
    )


def op9_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is ``spark.noteloom.pii.key``; where it is unset each call takes a random one and forgets it.

    ``keyed`` tells whether the session gave the key: only then do two calls agree.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.noteloom.pii.key", None)
    done = surrogates.substitute(docs, key.encode() if key else secrets.token_bytes(32))
    return done.withColumn("n_entities", F.size("entities")).withColumn("keyed", F.lit(bool(key)))


def surrogate_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surrogates of the whole table that stand for two originals or for themselves: no rows if all is well."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.noteloom.pii.key", None)
    return surrogates.own_collisions(docs, key.encode() if key else secrets.token_bytes(32))


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, TERMS AS terms FROM documents),
items AS (SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, unnest(TERMS) AS term FROM benchmark),
sized AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY r, term
),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term
),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM items JOIN weight USING (term) JOIN tf USING (term) JOIN sized USING (r), whole GROUP BY item_id, r, doc_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS k FROM scored WHERE score > 0
)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= 10
""".replace("TERMS", r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


#: DuckDB has no CRC-32, so the digits' checksum is folded bit by bit from the polynomial.
OP12_SQL = r"""
WITH RECURSIVE own AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM own),
crc(conv_id, s, i, c) AS (
  SELECT conv_id, s, 0, CAST(4294967295 AS BIGINT) FROM convs
  UNION ALL
  SELECT conv_id, s, i + 1,
    list_reduce(list_prepend(xor(c, CAST(ascii(substr(s, i + 1, 1)) AS BIGINT)), [CAST(0 AS BIGINT) FOR j IN range(8)]),
      lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
  FROM crc WHERE i < length(s)
),
heads AS (SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM crc WHERE i = length(s)),
joined AS (
  SELECT o.conv_id, 1 AS part, k, role, text FROM own o JOIN heads USING (conv_id) WHERE k > h
  UNION ALL
  SELECT c.conv_id, 0, k, role, text FROM heads c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 WHERE k <= h
),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
    string_agg(md5(length(role) || ':' || role || text) || md5(text), '') OVER w AS path
  FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY part, k ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
),
lengths AS (SELECT conv_id, max(depth) AS turns FROM paths GROUP BY conv_id),
node AS (
  SELECT path, depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CASE WHEN depth = turns THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
  FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth
),
kids AS (SELECT left(path, -64) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
sums AS (
  SELECT left(path, 64 * up) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM full_node) GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(n.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  sha256(n.ends) AS ends_sha256
FROM full_node n JOIN sums USING (path) LEFT JOIN node p ON n.depth > 0 AND p.path = left(n.path, -64)
"""


def op13_chunked_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_posting_list_neighbours": op1_posting_list_neighbours,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_chat_format": op3_chat_format,
    "op4_rule_quality": op4_rule_quality,
    "op5_piece_language_id": op5_piece_language_id,
    "op6_min_slack_packing": op6_min_slack_packing,
    "op7_transducer_token_counts": op7_transducer_token_counts,
    "op8_secret_scan": op8_secret_scan,
    "op9_fm_decontamination": op9_fm_decontamination,
    "op10_pii_surrogates": op10_pii_surrogates,
    "surrogate_collisions": surrogate_collisions,
    "op11_dual_tree_search": op11_dual_tree_search,
    "op12_burst_trie": op12_burst_trie,
    "op13_chunked_byte_bpe": op13_chunked_byte_bpe,
}
ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": OP3_SQL.replace("CONTROL", rf"'([<\[])(\\*)({chat_format.CONTROL})'"),
    "op11_dual_tree_search": OP11_SQL,
    "op12_burst_trie": OP12_SQL,
}
