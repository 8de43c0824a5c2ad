"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are lifted to the unit ball so that the largest inner product is the least
distance. Centroids come from a bounded sample, split evenly and then refined with a
penalty on large lists. Every distinct vector goes to its nearest list and, near a
boundary, to further lists, unless one it already has lies closer to that list's centroid
than the vector does. A query walks a neighbour graph of the centroids in memory, and goes
on while what it finds lies near the distance ratio; the lists within the ratio of the
nearest one's distance are searched. Lists above a bound are dealt into parts, all of
which are searched, so no task grows with a hot list.

Equal vectors are indexed once with their least ids: a result never needs more of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.session import cut


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds what the driver sees to place at most ``most_lists`` centroids.

    A walk over the centroids takes at least ``probes`` steps, and goes on as far as
    ``slack`` times ``ratio``. Neither bounds the lists that are searched: only ``ratio`` does.
    """

    list_rows: int = 256
    most_lists: int = 4096
    sample: int = 16_384
    replicas: int = 4
    boundary: float = 0.15
    spread: float = 0.3
    probes: int = 64
    ratio: float = 1.13
    slack: float = 1.1
    degree: int = 24
    part_rows: int = 4096


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    scaled = vectors / longest
    return np.c_[scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))].astype(np.float32)


def lift_queries(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.c_[unit, np.zeros(len(unit))].astype(np.float32)


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T)


def balanced_centroids(points: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """At most ``n`` centroids: even splits along the widest direction, then refinement."""
    groups = [np.arange(len(points))]
    while len(groups) < n and max(map(len, groups)) > 1:
        groups.sort(key=len)
        rows = groups.pop()
        part = points[rows] - points[rows].mean(axis=0)
        axis = np.linalg.eigh(part.T @ part)[1][:, -1]
        order = rows[np.argsort(part @ axis, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    centroids = np.array([points[g].mean(axis=0) for g in groups])
    sizes = np.array([len(g) for g in groups], float)
    for _ in range(rounds):
        d = square_distances(points, centroids)
        near = (d + 0.1 * d.min(axis=1).mean() * (sizes / sizes.mean() - 1)).argmin(axis=1)
        sizes = np.bincount(near, minlength=len(centroids)).astype(float)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return np.ascontiguousarray(centroids[sizes > 0], np.float32)


class Lists:
    """The centroids with their neighbour graph; at most ``most_lists`` of them, so its size is bounded."""

    def __init__(self, centroids: np.ndarray, settings: Settings):
        self.centroids, self.settings = centroids, settings
        d = square_distances(centroids, centroids)
        self.apart = d.astype(np.float32)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : settings.degree]
        both = [set(x.tolist()) for x in near]
        for i, x in enumerate(near):  # every edge goes both ways
            for j in x.tolist():
                both[j].add(i)
        self.edges = [np.array(sorted(x - {i}), np.int64) for i, x in enumerate(both)]
        step = max(1, len(centroids) // 16)
        self.entries = np.union1d(np.arange(0, len(centroids), step), self.component_heads())

    def component_heads(self) -> np.ndarray:
        """One centroid of each connected part of the graph, so that a walk can come to all of them."""
        seen, heads = np.zeros(len(self.edges), bool), []
        for i in range(len(self.edges)):
            if not seen[i]:
                heads.append(i)
                seen[i], open_ = True, [i]
                while open_:
                    x = self.edges[open_.pop()]
                    fresh = x[~seen[x]]
                    seen[fresh] = True
                    open_ += fresh.tolist()
        return np.array(heads, np.int64)

    def assign(self, points: np.ndarray) -> list[list[int]]:
        """Lists of each vector: the nearest, and near a boundary those that no chosen one is closer to."""
        d = square_distances(points, self.centroids)
        most = min(self.settings.replicas * 3, d.shape[1])
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        out = []
        for row, some in zip(d, near, strict=True):
            order = some[np.argsort(row[some], kind="stable")]
            limit = row[order[0]] * (1 + self.settings.boundary) ** 2
            chosen = [int(order[0])]
            for j in order[1:].tolist():
                if row[j] > limit or len(chosen) == self.settings.replicas:
                    break
                if (self.apart[j, chosen] >= self.settings.spread * row[j]).all():
                    chosen.append(j)
            out.append(chosen)
        return out

    def probe(self, query: np.ndarray) -> list[int]:
        """The lists within the distance ratio that a walk over the graph finds, the nearest first.

        A range search: a centroid's neighbours are measured if it is among the ``probes``
        nearest so far, or within ``slack`` times the ratio. Others are never measured.
        """
        settings = self.settings
        away = np.full(len(self.centroids), np.inf)

        def measure(some: np.ndarray) -> list[tuple[float, int]]:
            away[some] = ((self.centroids[some] - query) ** 2).sum(axis=1)
            return list(zip(away[some].tolist(), some.tolist(), strict=True))

        seen = np.zeros(len(self.centroids), bool)
        seen[self.entries] = True
        open_ = measure(self.entries)
        heapq.heapify(open_)
        least, walked = open_[0][0], 0
        while open_:
            x, j = heapq.heappop(open_)
            if walked >= settings.probes and x > least * (settings.ratio * settings.slack) ** 2:
                break
            walked += 1
            fresh = self.edges[j][~seen[self.edges[j]]]
            seen[fresh] = True
            for found in measure(fresh):
                least = min(least, found[0])
                heapq.heappush(open_, found)
        within = np.flatnonzero(away <= least * settings.ratio**2)
        return within[np.argsort(away[within], kind="stable")].tolist()


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as rows of double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def assigned(batches: Iterable[pa.RecordBatch], lists: Lists, longest: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = matrix(batch.column(1))
        places = [x for at in range(0, len(vectors), 1024) for x in lists.assign(lift(vectors[at : at + 1024], longest))]
        rows = pa.array(np.repeat(np.arange(len(places)), [len(x) for x in places]))
        found = pa.array([j for x in places for j in x], pa.int32())
        yield pa.RecordBatch.from_arrays([found, *[c.take(rows) for c in batch.columns]], names=["list", "node", "vector", "ids"])


def probed(batches: Iterable[pa.RecordBatch], lists: Lists) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = [lists.probe(q) for q in lift_queries(matrix(batch.column(1)))]
            columns = [batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "lists", "vector"])


def searched(batches: Iterable[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The best of each part for each query sent there; a part's vectors come before its queries."""
    key, nodes, ids, held = None, np.empty(0, np.int64), [], []
    stacked: np.ndarray | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
        asks = batch.column(2).to_numpy(zero_copy_only=False)
        numbers, vectors = batch.column(3).to_numpy(zero_copy_only=False), matrix(batch.column(4))
        marks = np.c_[keys, asks]
        bounds = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
        out: list[tuple] = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            if key is None or (keys[a] != key).any():
                key, held, nodes, ids, stacked = keys[a], [], np.empty(0, np.int64), [], None
            if not asks[a]:
                held.append(vectors[a:b])
                nodes = np.concatenate([nodes, numbers[a:b]])
                ids += batch.column(5).slice(a, b - a).to_pylist()
                continue
            if not held:
                continue
            stacked = np.concatenate(held) if stacked is None else stacked
            for at in range(a, b, 256):
                some = vectors[at : min(b, at + 256)]
                scores = some @ stacked.T
                for q, row in zip(numbers[at : at + len(some)].tolist(), scores, strict=True):
                    if len(row) > top:
                        floor = np.partition(row, len(row) - top)[len(row) - top]
                        near = np.flatnonzero(row >= floor)
                    else:
                        near = np.arange(len(row))
                    near = near[np.lexsort((nodes[near], -row[near]))][:top]
                    out.append((q, row[near].tolist(), nodes[near].tolist(), [ids[i] for i in near.tolist()]))
        if out:
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "scores", "nodes", "ids"])


def merged(batches: Iterable[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The best over all parts; rows come sorted by query, and one query's best so far is held."""

    def close(query: int, best: dict[int, tuple]) -> tuple:
        flat = [(-score, i) for score, ids in best.values() for i in ids]
        flat = heapq.nsmallest(top, flat)
        return query, [-s for s, _ in flat], [i for _, i in flat]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query", "scores", "ids"])

    query, best, out = None, {}, []
    for batch in batches:
        for q, scores, nodes, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if q != query:
                if best:
                    out.append(close(query, best))
                query, best = q, {}
            for score, node, copies in zip(scores, nodes, ids, strict=True):
                if node not in best:
                    best[node] = (score, copies)
            if len(best) > 8 * top:
                keep = heapq.nsmallest(top, best, key=lambda n: (-best[n][0], n))
                best = {n: best[n] for n in keep}
        yield batch_of(out)
        out = []
    if best:
        yield batch_of([close(query, best)])


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    settings: Settings = Settings(),
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id ``every`` divides.

    Score is the inner product in double precision; ties go to the smaller id. Rows with
    a null id, and vectors that are null, empty, zero, of another than the commonest
    length (the shorter of equally common ones) or with null or non-finite components
    take no part. A row that repeats is one row; rows of one id with different vectors
    all take part, and none of them is a candidate of its own id. Tables of fewer
    candidates give shorter lists. Other columns are not read.
    """
    v = F.col(vector_col)
    kind = "float" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = vectors.where(F.col(id_col).isNotNull() & sound & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast(f"array<{kind}>").alias("vector")
    )
    common = named.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = named.where(F.size("vector") == common.dim).withColumn("h", F.xxhash64("vector"))
    same = Window.partitionBy("h", "vector")
    least = rows.withColumn("place", F.dense_rank().over(same.orderBy("vec_id"))).where(F.col("place") <= k + 1)
    distinct = cut(
        least.groupBy("h", "vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("node"), "vector", "ids", "h")
    )
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size = distinct.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    n_lists = max(1, min(settings.most_lists, size.n // settings.list_rows))
    some = distinct.orderBy(F.xxhash64("h"), "node").limit(settings.sample).select("vector").collect()
    points = lift(np.array([r.vector for r in some], np.float64), size.longest)
    lists = Lists(balanced_centroids(points.astype(np.float64), n_lists), settings)

    typed = f"vector array<{kind}>"
    placed = distinct.select("node", "vector", "ids").mapInArrow(
        lambda it: assigned(it, lists, size.longest), f"list int, node long, {typed}, ids array<long>"
    )
    placed = cut(placed)
    parts = placed.groupBy("list").agg(F.ceil(F.count("*") / settings.part_rows).cast("int").alias("parts"))
    parts = F.broadcast(parts)  # a row a list, at most most_lists of them
    ours = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "h", "vector").distinct()
    asked = ours.groupBy("h", "vector").agg(F.min("vec_id").alias("query"))
    routes = asked.select("query", "vector").mapInArrow(lambda it: probed(it, lists), f"query long, lists array<int>, {typed}")
    routes = routes.select("query", "vector", F.explode("lists").alias("list")).join(parts, "list")
    routes = routes.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query", "vector")
    dealt = placed.join(parts, "list").select(
        "list", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), F.col("node").alias("number"), "vector", "ids"
    )
    meet = dealt.unionByName(
        routes.select("list", "part", F.lit(True).alias("asks"), F.col("query").alias("number"), "vector", F.array().cast("array<long>").alias("ids"))
    )
    meet = meet.repartition("list", "part").sortWithinPartitions("list", "part", "asks")
    best = meet.mapInArrow(lambda it: searched(it, k + 1), "query long, scores array<double>, nodes array<long>, ids array<array<long>>")
    found = best.repartition("query").sortWithinPartitions("query").mapInArrow(
        lambda it: merged(it, k + 1), "query long, scores array<double>, ids array<long>"
    )
    answers = ours.join(asked, ["h", "vector"]).select("vec_id", "query").join(found, "query")
    pairs = F.arrays_zip("scores", "ids")
    others = F.slice(F.filter(pairs, lambda x: x["ids"] != F.col("vec_id")), 1, k)
    flat = answers.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
