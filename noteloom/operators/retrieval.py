"""Ranking notes: BM25 over terms, cosine over vectors, their mixture, near-duplicate classes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from noteloom.session import cut

#: White space of any Unicode kind, slashes and hyphens.
TOKEN_SPLIT = r"[\t-\r\x1c- /\-\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def terms(text: Column) -> Column:
    """Lower-case terms between white space, slashes and hyphens; other marks stay part of them."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda x: x != "")


@dataclass
class Queries:
    """Numbers of the terms of queries and how often each stands there; those of query ``q`` from ``ptr[q]`` to ``ptr[q + 1]``."""

    ptr: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, lists: list[list[str]], number: dict[str, int]) -> Queries:
        counted = [sorted(Counter(number[t] for t in x).items()) for x in lists]
        flat = np.array([p for c in counted for p in c], np.int64).reshape(-1, 2)
        return cls(np.cumsum([0, *map(len, counted)]), flat[:, 0].copy(), flat[:, 1].copy())


@dataclass
class Met:
    """Which query of some has, how often, a term that a run of notes has too."""

    owner: np.ndarray
    times: np.ndarray
    entry: np.ndarray


class TermBlock:
    """An inverted index of a task's notes over the terms of a block of queries, with the most that a term adds in each run of ``RUN`` notes.

    Notes are put in the order of their heaviest term, so that a run's bounds are near what its notes reach.
    """

    RUN = 64

    def __init__(self, paths: list[str], lengths: np.ndarray, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, idf: np.ndarray, average: float, k1: float, b: float):
        part = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[rows] / (average or 1.0)))
        heaviest = np.full(len(paths), len(idf))
        order = np.lexsort((part, rows))
        last = np.flatnonzero(np.diff(rows[order], append=-1))
        heaviest[rows[order][last]] = terms[order][last]
        by = np.argsort(heaviest, kind="stable")
        place = np.empty(len(paths), np.int64)
        place[by] = np.arange(len(paths))
        self.paths = [paths[i] for i in by.tolist()]
        by_path = np.empty(len(paths), np.int64)
        by_path[np.array(sorted(range(len(paths)), key=self.paths.__getitem__), np.int64)] = np.arange(len(paths))
        self.by_path = by_path
        order = np.lexsort((place[rows], terms))
        self.rows, self.parts = place[rows][order], part[order]
        self.ptr = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.runs = -(-len(paths) // self.RUN)
        run = terms[order] * self.runs + self.rows // self.RUN
        first = np.flatnonzero(np.diff(run, prepend=-1))
        self.first = np.append(first, len(run))
        self.bound = np.maximum(np.maximum.reduceat(self.parts, first), 0) if len(first) else self.parts
        self.bound_run = run[first] % self.runs
        self.bound_ptr = np.searchsorted(run[first] // self.runs, np.arange(len(idf) + 1))
        self.in_path = np.argsort(self.by_path, kind="stable")

    def chosen(self, score: np.ndarray, k: int, least: float) -> np.ndarray:
        """The ``k`` best notes of one query that reach ``least``, best first, ties in path order."""
        k = min(k, len(score))
        if least > 0:  # few notes reach it
            found = np.flatnonzero(score >= least)
            if len(found) > k:
                found = found[score[found] >= np.partition(score[found], -k)[-k]]
            return found[np.lexsort((self.by_path[found], -score[found]))][:k]
        bar = max(np.partition(score, -k)[-k], least)
        above = np.flatnonzero(score > bar)
        equal = np.flatnonzero(score[self.in_path] == bar)[: k - len(above)] if len(above) < k else above[:0]
        return np.concatenate([above[np.lexsort((self.by_path[above], -score[above]))], self.in_path[equal]])

    def best(self, terms: list[tuple[int, int]], k: int, least: float) -> list[tuple[str, float]]:
        """The ``k`` best notes of one query, ties in path order, as far as they reach ``least``."""
        numbers, times = np.array(terms, np.int64).reshape(-1, 2).T
        _, rows, score = self.best_of_each(Queries(np.array([0, len(terms)]), numbers, times), k, np.array([least]))
        return [(self.paths[i], float(x)) for i, x in zip(rows.tolist(), score, strict=True)]

    def best_of_each(self, queries: Queries, k: int, least: np.ndarray, most: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the queries, their best notes and scores; ``most`` queries go together, so that none costs calls of its own for each term."""
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for at in range(0, len(least), most):
            found += self.some_best(queries, at, min(at + most, len(least)), k, least)
        numbers = np.repeat(np.array([q for q, _, _ in found], np.int64), [len(rows) for _, rows, _ in found])
        return numbers, np.concatenate([np.empty(0, np.int64), *[r for _, r, _ in found]]), np.concatenate([np.empty(0), *[x for _, _, x in found]])

    def scores(self, met: Met, allowed: np.ndarray) -> np.ndarray:
        """Scores of some queries' ``allowed`` runs of notes; 0 elsewhere."""
        fits = allowed.ravel()[met.owner * self.runs + self.bound_run[met.entry]]
        begin = self.first[met.entry[fits]]
        lengths = self.first[met.entry[fits] + 1] - begin
        place, size = ranges(begin, lengths), len(self.paths)
        key = np.repeat(met.owner[fits] * size, lengths) + self.rows[place]
        return np.bincount(key, self.parts[place] * np.repeat(met.times[fits], lengths), len(allowed) * size).reshape(len(allowed), size)

    def some_best(self, queries: Queries, low: int, high: int, k: int, least: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        n, k, at = high - low, min(k, len(self.paths)), slice(queries.ptr[low], queries.ptr[high])
        terms, owner = queries.terms[at], np.repeat(np.arange(n), np.diff(queries.ptr[low : high + 1]))
        counts = self.bound_ptr[terms + 1] - self.bound_ptr[terms]
        met = Met(np.repeat(owner, counts), np.repeat(queries.times[at], counts), ranges(self.bound_ptr[terms], counts))
        cell = met.owner * self.runs + self.bound_run[met.entry]
        bounds = np.bincount(cell, self.bound[met.entry] * met.times, n * self.runs).reshape(n, self.runs)
        floor = least[low:high]
        if (floor <= 0).any():  # the heaviest runs say what a query reaches at least
            few = min(1 + 4 * k // self.RUN + 1, self.runs)
            allowed = np.zeros((n, self.runs), bool)
            np.put_along_axis(allowed, np.argpartition(-bounds, few - 1, axis=1)[:, :few], True, axis=1)
            floor = np.maximum(np.partition(self.scores(met, allowed), -k, axis=1)[:, -k], floor)
        # runs below a positive floor can't matter, notes without any of the terms neither
        score = np.round(self.scores(met, (bounds >= floor[:, None] - 2e-6) | (floor <= 0)[:, None]), 6)
        known, out = np.bincount(met.owner, minlength=n) > 0, []
        for q in range(n):
            if known[q]:
                rows = self.chosen(score[q], k, np.round(floor[q], 6) - 1e-6 if floor[q] > 0 else -np.inf)
            else:
                rows = self.in_path[: k if floor[q] <= 0 else 0]
            out.append((low + q, rows, score[q, rows]))
        return out


def ranges(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begin - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def best_notes(
    batches: Iterable[pa.RecordBatch], ids: pa.Array, queries: Queries, vocabulary: list[str], idf: np.ndarray, least: np.ndarray, average: float, k: int, k1: float, b: float, most: int = 1 << 14
) -> Iterator[pa.RecordBatch]:
    """Each query's best notes of a task's, ``most`` notes at a time."""
    known = pa.array(vocabulary, pa.string())

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        paths, lists = table.column(0).to_pylist(), table.column(1).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lengths = np.diff(lists.offsets.to_numpy())
        term = pc.index_in(lists.flatten(), value_set=known)
        there = term.is_valid().to_numpy(zero_copy_only=False)
        key = np.repeat(np.arange(len(paths)), lengths)[there] * max(len(vocabulary), 1) + term.drop_null().to_numpy()
        pairs, tf = np.unique(key, return_counts=True)
        index = TermBlock(paths, lengths.astype(float), pairs // max(len(vocabulary), 1), pairs % max(len(vocabulary), 1), tf.astype(float), idf, average, k1, b)
        numbers, rows, score = index.best_of_each(queries, k, least)
        found = pa.array(index.paths, pa.string()).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(numbers)), found, pa.array(score, pa.float64())], names=["query_id", "path", "score"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            yield block(held)
            held, n = [], 0
    if held:
        yield block(held)


def query_blocks(queries: DataFrame, most: int) -> Iterator[list]:
    """Queries ``query_id, t`` with at most ``most`` terms in all at a time; only one block is at the driver."""
    held, size = [], 0
    for row in queries.toLocalIterator():
        if held and size + len(row.t) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row.t)
    if held:
        yield held


def bm25(notes: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, block: int = 1 << 18, one_in: int = 64) -> DataFrame:
    """``query_id, path, score, rank``: the ``k`` best notes of each query, also those without a common term.

    Terms are split once and written; document counts and the floor for common terms are taken
    over the whole vocabulary. Queries meet the notes in blocks of ``block`` terms, each a pass over
    the written terms, in which every task keeps an index of its notes and skips runs of them whose bounds
    stay below a query's kth score; a sample of one note in ``one_in`` says what that is at least.
    Notes without any of a query's terms score 0; equal scores go in path order. Queries that are null have no terms.
    """
    spark = notes.sparkSession
    sized = cut(notes.select("path", F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("t")))
    stats = sized.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl")).first()
    df = cut(sized.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    raw = df.withColumn("raw", F.log(F.lit(float(stats.n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    kind = queries.schema["query_id"].dataType
    schema = f"query_id {kind.simpleString()}, path string, score double"
    asked = queries.select("query_id", F.coalesce(terms(F.col("query")), F.array().cast("array<string>")).alias("t"))
    out = spark.createDataFrame([], schema)
    for some in query_blocks(asked, block):
        vocabulary = sorted({t for r in some for t in r.t})
        number = {t: i for i, t in enumerate(vocabulary)}
        idf = np.zeros(len(vocabulary))
        wanted = spark.createDataFrame([(t,) for t in vocabulary], "term string")
        for r in raw.join(wanted, "term").collect():  # no more rows than the block has terms
            idf[number[r.term]] = epsilon * mean if r.raw < 0 else r.raw
        counted = Queries.of([r.t for r in some], number)
        ids = pa.array([r.query_id for r in some], to_arrow_type(kind))
        average, nothing = float(stats.avgdl or 1.0), np.full(len(some), -np.inf)
        sent = spark.sparkContext.broadcast((ids, counted, vocabulary, idf))

        def search(rows: DataFrame, least: np.ndarray, sent=sent, average=average) -> DataFrame:
            return rows.mapInArrow(lambda it: best_notes(it, *sent.value, least, average, k, k1, b), schema)

        sample = top(search(sized.where(F.pmod(F.xxhash64("path"), F.lit(one_in)) == 0), nothing), k).where(F.col("rank") == k)
        kth = {r.query_id: r.score for r in sample.select("query_id", "score").collect()}  # one row a query of the block
        out = out.unionByName(search(sized, np.array([kth.get(r.query_id, -np.inf) for r in some])))
    return top(out, k)


def scored_blocks(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The ``k`` nearest of a part of the vectors for each query of a block."""
    for f in frames:
        out = []
        for asked, part in zip(f["asked"], f["part"], strict=True):
            ids, rows = np.array([r["vec_id"] for r in part]), np.array([r["v"] for r in part], np.float64)
            length = np.linalg.norm(rows, axis=1)
            for q in asked:
                v = np.array(q["v"], np.float64)
                norm = length * np.linalg.norm(v)
                score = np.round(np.divide(rows @ v, norm, out=np.zeros(len(rows)), where=norm > 0), 6)
                score[ids == q["vec_id"]] = -np.inf
                for i in np.lexsort((ids, -score))[:k].tolist():
                    if score[i] > -np.inf:
                        out.append((q["vec_id"], ids[i], score[i]))
        yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 512, part: int = 4096) -> DataFrame:
    """``query_id, vec_id, score, rank``: the ``k`` rows of largest cosine for each query, over all rows but its own.

    Both are ``vec_id, v`` with vectors of one length. Blocks of queries meet parts of the
    vectors, each pair of them in a row of its own, and only the best of each part go on.
    """
    n_blocks, n_parts = -(-queries.count() // block) or 1, -(-vectors.count() // part) or 1
    row = F.collect_list(F.struct("vec_id", "v"))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")
    asked = queries.groupBy(number).agg(row.alias("asked"))
    parts = vectors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)).alias("number")).agg(row.alias("part"))
    met = parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).join(asked, "block")
    found = met.select("asked", "part").mapInPandas(lambda it: scored_blocks(it, k), "query_id long, vec_id long, score double")
    return top(found, k, tie="vec_id")


def top(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "path") -> DataFrame:
    """The ``k`` best of each group, ties in the order of ``tie``, with their ``rank``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for empty, unequal or zero vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def hybrid(bm: Column, cos: Column) -> Column:
    """A vector's cosine and the capped term score; the bare term score where there is no vector."""
    return F.when(cos.isNull(), bm).otherwise(0.4 * F.least(bm / 10, F.lit(1.0)) + 0.6 * cos)


def similarity_class(score: Column, high: float = 0.85, low: float = 0.55) -> Column:
    return F.when(score >= high, "duplicate").when(score >= low, "ambiguous").otherwise("distinct")


def resolution(kind: Column, verdict: Column) -> Column:
    """Create or update: duplicates update, ambiguous ones follow the verdict, others are created."""
    update = (kind == "duplicate") | ((kind == "ambiguous") & verdict.isin("reuse", "extend"))
    return F.when(F.coalesce(update, F.lit(False)), "update").otherwise("create")


def searched(notes: DataFrame, queries: DataFrame, k: int, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """``query_id, path, score, rank``: the ``3 k`` best notes by terms, put in order by the mixed score, the first ``k``.

    ``vectors (path, vector)`` and ``query_vectors (query_id, q)`` are of one model; a note or query without one keeps
    its term score. Equal mixed scores keep the order of the term scores.
    """
    first = bm25(notes, queries, max(3 * k, k)).withColumnRenamed("rank", "first")
    if vectors is None or query_vectors is None:
        mixed = first.withColumn("mixed", F.col("score"))
    else:
        both = first.join(query_vectors, "query_id", "left").join(vectors, "path", "left")
        cos = F.when(F.col("q").isNotNull() & F.col("vector").isNotNull(), cosine(F.col("q"), F.col("vector")))
        mixed = both.withColumn("mixed", F.round(hybrid(F.col("score"), cos), 6))
    found = mixed.select("query_id", "path", F.col("mixed").alias("score"), "first")
    return top(found, k, tie="first").drop("first")


def plan_queries(plans: DataFrame) -> DataFrame:
    """``query_id, query`` of planned notes ``note_id, title, headings``: the title and the headings of its parts."""
    words = F.concat_ws(" ", F.array("title"), F.coalesce("headings", F.array().cast("array<string>")))
    return plans.select(F.col("note_id").alias("query_id"), words.alias("query"))


def resolved_plans(plans: DataFrame, hits: DataFrame, verdicts: DataFrame, high: float = 0.85, low: float = 0.55) -> DataFrame:
    """``note_id, score, class, action, existing_path, needs_folder``: what becomes of each planned note.

    ``hits`` has each plan's best note (rank 1), ``verdicts`` ``note_id, verdict`` for ambiguous ones. A plan without a hit
    is a new note; a duplicate, or an ambiguous one to be reused or extended, updates the note found.
    """
    best = hits.where(F.col("rank") == 1).select(F.col("query_id").alias("note_id"), "path", "score")
    rows = plans.select("note_id").join(best, "note_id", "left").join(verdicts.select("note_id", "verdict").dropDuplicates(["note_id"]), "note_id", "left")
    kind = F.when(F.col("path").isNotNull(), similarity_class(F.col("score"), high, low))
    out = rows.select("note_id", "score", kind.alias("class"), "path", "verdict").withColumn("action", resolution(F.coalesce("class", F.lit("distinct")), F.col("verdict")))
    update = F.col("action") == "update"
    return out.select("note_id", "score", "class", "action", F.when(update, F.col("path")).alias("existing_path"), (~update).alias("needs_folder"))
