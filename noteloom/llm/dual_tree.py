"""Exact lexical top k of many items over many documents, by a search of two trees at once.

A document's coordinate at a term is its saturated, length-normalised count; an item's is the
term's weight where it holds the term. Both sides get a hierarchy whose nodes hold the maxima
of what is below them, coordinate by coordinate. The product of an item node and a document
node bounds every score between the two; a pair whose bound is below the weakest kth score
of the node's items is dropped with all that is below it. Bounds only drop what cannot be
among the best, so the result is exact. Every task has the trees of its own documents; kth
scores found first over a sample of the documents let all tasks prune from the start.
Scores are 64-bit integers throughout.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.tables import batches_of, giving_back, small_batches
from noteloom.session import cut

#: Bytes that are part of a term map to themselves, capital letters A-Z to small ones, all others to a space.
TERM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
SLICE = 1 << 20
#: Documents of a leaf, items of a leaf, children of an inner node.
DOC_LEAF, ITEM_LEAF, FAN = 64, 8, 4
#: Documents and coordinates that a task holds in one tree; cells of a block of scores.
TREE_DOCS, TREE_CELLS, CELLS = 1 << 14, 1 << 21, 1 << 21
#: Term occurrences of a block of items: what is sent to every task at once, some 30 bytes each.
BLOCK = 1 << 20
FEATURES = "doc_id long, n long, terms binary, counts binary"
FOUND = "item_no int, doc_id long, score long"
RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(raw: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, slice by slice, so that a long text is never a list of all its terms."""
    raw, at = raw or b"", 0
    while at < len(raw):
        piece = raw[at : at + SLICE].translate(TERM)
        if at + SLICE < len(raw):
            end = piece.rfind(b" ") + 1
            if not end:  # a term longer than a slice
                rest = raw[at:].translate(TERM)
                end = (rest.find(b" ") + 1) or len(rest)
                piece = rest
            piece = piece[:end]
        yield piece.split()
        at += len(piece)


def item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for terms in terms_of(raw):
                if own := set(terms):
                    yield batches_of("item_id long, term binary", [item] * len(own), list(own))


def features(batches: Iterable[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Number of terms of each document that has any, and its counts of the items' terms."""
    known = vocabulary.get
    for batch in batches:
        rows = []
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, counts = 0, Counter()
            for terms in terms_of(raw):
                n += len(terms)
                counts.update(map(known, terms))
            counts.pop(None, None)
            if n:
                rows.append((doc, n, np.array(list(counts), "<i4").tobytes(), np.array(list(counts.values()), "<i4").tobytes()))
        if rows:
            yield batches_of(FEATURES, *zip(*rows, strict=True))


def document_counts(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How many of a task's documents hold each term."""
    total = np.zeros(size, np.int64)
    for batch in batches:
        total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
    held = np.flatnonzero(total)
    yield batches_of("term int, df long", held, total[held])


class Sparse:
    """Rows of (column, value), sorted by row and column."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, width: int):
        key = rows.astype(np.int64) * width + columns
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.columns = key[first] % width
        self.values = np.maximum.reduceat(values[order], first) if len(first) else values[:0]
        self.rows = key[first] // width
        self.ptr = np.searchsorted(self.rows, np.arange(n_rows + 1))
        self.n, self.width = n_rows, width

    def parents(self) -> Sparse:
        """Maxima of ``FAN`` neighbours."""
        return Sparse(self.rows // FAN, self.columns, self.values, -(-self.n // FAN), self.width)

    def taken(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of ``rows``, none of them empty, are, and where each row's begin among these."""
        sizes = self.ptr[rows + 1] - self.ptr[rows]
        begin = np.cumsum(sizes) - sizes
        return np.repeat(self.ptr[rows] - begin, sizes) + np.arange(sizes.sum()), begin


def levels(leaves: Sparse) -> list[Sparse]:
    out = [leaves]
    while out[-1].n > 1:
        out.append(out[-1].parents())
    return out


class Items:
    """The items' tree: level 0 holds the items, the others the maxima below their nodes.

    ``rows`` are the items' term numbers, ``weights`` those of the terms; no item is without terms.
    Items are put beside those that share their commonest terms.
    """

    def __init__(self, rows: list[np.ndarray], weights: np.ndarray):
        order = sorted(range(len(rows)), key=lambda i: sorted(weights[rows[i]].tolist())[:4])
        self.numbers = np.array(order)
        at = np.repeat(np.arange(len(rows)), [len(rows[i]) for i in order])
        columns = np.concatenate([rows[i] for i in order])
        items = Sparse(at, columns, weights[columns], len(rows), len(weights))
        leaves = Sparse(at // ITEM_LEAF, columns, weights[columns], -(-len(rows) // ITEM_LEAF), len(weights))
        self.levels = [items, *levels(leaves)]

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The nodes of the next level down, or the items, that are below ``nodes``."""
        fan = ITEM_LEAF if level == 1 else FAN
        found = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return found[found < self.levels[level - 1].n]


class Best:
    """The best documents so far of each item, and the score below which none matters."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = np.maximum(least, 1), k
        self.held: dict[int, list[tuple]] = {}

    def add(self, item: int, scores: np.ndarray, docs: list) -> None:
        found = [(-s, d is not None, d or 0) for s, d in zip(scores.tolist(), docs, strict=True)]
        held = sorted(self.held.get(item, []) + found)[: self.k]
        self.held[item] = held
        if len(held) == self.k:
            self.least[item] = max(self.least[item], -held[-1][0])

    def rows(self, numbers: np.ndarray) -> Iterator[tuple]:
        for item, held in self.held.items():
            for score, known, doc in held:
                yield int(numbers[item]), doc if known else None, -score


def weakest(least: np.ndarray, tree: Items) -> list[np.ndarray]:
    """For each level of the items' tree the weakest score that matters to a node."""
    out = [least, np.minimum.reduceat(least, np.arange(0, len(least), ITEM_LEAF))]
    while len(out) < len(tree.levels):
        out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), FAN)))
    return out


class Documents:
    """The tree of one task's documents, those with heavy coordinates in common beside each other."""

    def __init__(self, ids: list, lengths: np.ndarray, terms: list[bytes], counts: list[bytes], weights: np.ndarray):
        sizes = np.array([len(t) // 4 for t in terms])
        columns = np.frombuffer(b"".join(terms), "<i4").astype(np.int64)
        tf = np.frombuffer(b"".join(counts), "<i4").astype(np.int64)
        rows = np.repeat(np.arange(len(ids)), sizes)
        values = (1_000_000_000 * tf) // (1000 * tf + 8 * lengths[rows])
        width = len(weights)
        heaviest = np.maximum.reduceat(weights[columns] * values * width + columns, np.cumsum(sizes) - sizes)
        order = np.lexsort((-(heaviest // width), heaviest % width))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = [ids[i] for i in order]
        self.docs = Sparse(place[rows], columns, values, len(ids), width)
        self.levels = levels(Sparse(place[rows] // DOC_LEAF, columns, values, -(-len(ids) // DOC_LEAF), width))

    def search(self, items: Items, weights: np.ndarray, best: Best) -> int:
        """Let ``best`` meet all documents that may matter to it; how many scores were computed."""
        product, scored = np.zeros(len(weights), np.int64), 0
        top = len(items.levels) - 1
        floors = weakest(best.least, items)
        stack = [(len(self.levels) - 1, 0, top, np.arange(items.levels[top].n))]
        while stack:
            level, node, depth, active = stack.pop()
            tree = self.levels[level]
            at = slice(tree.ptr[node], tree.ptr[node + 1])
            held = tree.columns[at]
            product[held] = tree.values[at] * weights[held]
            while len(active):
                entries, begin = items.levels[depth].taken(active)
                bounds = np.add.reduceat(product[items.levels[depth].columns[entries]], begin)
                active = active[bounds >= floors[depth][active]]
                if not depth or level:  # a leaf goes on down to single items
                    break
                active, depth = items.below(depth, active), depth - 1
            product[held] = 0
            if not len(active):
                continue
            if level:
                if depth > 1:
                    active, depth = items.below(depth, active), depth - 1
                last = min((node + 1) * FAN, self.levels[level - 1].n)
                stack += [(level - 1, child, depth, active) for child in range(last - 1, node * FAN - 1, -1)]
            else:
                scored += self.score(node, items, weights, active, best)
                floors = weakest(best.least, items)
        return scored

    def score(self, leaf: int, items: Items, weights: np.ndarray, active: np.ndarray, best: Best) -> int:
        first, last = leaf * DOC_LEAF, min((leaf + 1) * DOC_LEAF, len(self.ids))
        at = slice(self.docs.ptr[first], self.docs.ptr[last])
        held, place = np.unique(self.docs.columns[at], return_inverse=True)
        cells = np.zeros((len(held) + 1, last - first), np.int64)
        cells[place, self.docs.rows[at] - first] = self.docs.values[at] * weights[self.docs.columns[at]]
        row = np.full(len(weights), len(held))
        row[held] = np.arange(len(held))
        tree, size = items.levels[0], np.diff(items.levels[0].ptr)
        for part in np.split(active, np.flatnonzero(np.diff(np.cumsum(size[active]) * (last - first) // CELLS)) + 1):
            entries, begin = tree.taken(part)
            scores = np.add.reduceat(cells[row[tree.columns[entries]]], begin, axis=0)
            hits = scores >= best.least[part][:, None]
            for i in np.flatnonzero(hits.any(axis=1)).tolist():
                docs = np.flatnonzero(hits[i])
                best.add(int(part[i]), scores[i, docs], [self.ids[first + d] for d in docs.tolist()])
        return len(active) * (last - first)


def normal_length(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - 90 + (90 * n * n_docs) // n_terms


def searched(
    batches: Iterable[pa.RecordBatch], rows: list[np.ndarray], weights: np.ndarray, least: np.ndarray, n_docs: int, n_terms: int, k: int
) -> Iterator[pa.RecordBatch]:
    """The best documents of a task for each item, as far as they reach ``least``."""
    items = Items(rows, weights)
    best = Best(least[items.numbers], k)
    ids, lengths, terms, counts, cells = [], [], [], [], 0

    def flush() -> None:
        if ids:
            Documents(ids, np.array(lengths), terms, counts, weights).search(items, weights, best)
        for held in (ids, lengths, terms, counts):
            held.clear()

    for batch in batches:
        for doc, n, own, tf in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if not own:
                continue
            for held, value in zip((ids, lengths, terms, counts), (doc, normal_length(n, n_docs, n_terms), own, tf), strict=True):
                held.append(value)
            cells += len(own) // 4
            if len(ids) >= TREE_DOCS or cells >= TREE_CELLS:
                flush()
                cells = 0
    flush()
    if out := list(best.rows(items.numbers)):
        yield batches_of(FOUND, *zip(*out, strict=True))


def blocks(items: DataFrame, most: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and terms of the items, block by block; only one block is at the driver."""
    ids, terms, size = [], [], 0
    for row in items.toLocalIterator():
        if ids and size + len(row.terms) > most:
            yield ids, terms
            ids, terms, size = [], [], 0
        ids.append(row.item_id)
        terms.append([bytes(t) for t in row.terms])
        size += len(row.terms)
    if ids:
        yield ids, terms


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_top(docs: DataFrame, ids: list, terms: list[list[bytes]], k: int, one_in: int) -> DataFrame:
    """``RESULT`` for one block of items over all documents."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for own in terms for t in own))}
    rows = [np.array(sorted(vocabulary[t] for t in own)) for own in terms]
    share = spark.sparkContext.broadcast(vocabulary)
    counted = cut(docs.mapInArrow(lambda it: giving_back(features, it, share.value), FEATURES))
    whole = counted.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms")).first()
    if not whole.n_docs:
        return spark.createDataFrame([], RESULT)
    size, n_docs, n_terms = len(vocabulary), whole.n_docs, whole.n_terms
    partial = counted.select("terms").mapInArrow(lambda it: document_counts(it, size), "term int, df long")
    weights = np.full(size, math.floor(1000 * math.log(2 * n_docs + 2)), np.int64)
    for row in partial.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        weights[row.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
    sent = spark.sparkContext.broadcast((rows, weights))

    def search(some: DataFrame, least: np.ndarray) -> DataFrame:
        floor = spark.sparkContext.broadcast(least)
        return some.mapInArrow(lambda it: giving_back(searched, it, *sent.value, floor.value, n_docs, n_terms, k), FOUND)

    sample = counted.where(F.pmod(F.xxhash64("doc_id", "n", "counts"), F.lit(one_in)) == 0)
    least = np.zeros(len(rows), np.int64)
    for row in best_of(search(sample, least), k).where(F.col("rank") == k).select("item_no", "score").toLocalIterator():
        least[row.item_no] = row.score
    names = spark.createDataFrame(list(enumerate(ids)), "item_no int, item_id long")
    return best_of(search(counted, least), k).join(names, "item_no").select("item_id", "rank", "doc_id", "score")


def top_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    block: int = BLOCK,
    one_in: int = 64,
) -> DataFrame:
    """``RESULT``: the ``k`` documents of ``docs`` with the highest scores above 0 for each item of ``items``.

    A term is a maximal run of ASCII letters, digits and non-ASCII characters, A-Z lowered. Equal
    scores go by ascending document id, null first. Rows that share an item id, also the null one, are
    one item with the terms of all; an item or document without terms has no rows, nor has an
    empty table. Every row of ``docs`` is a document of its own, also where ids repeat. Other columns
    are not read. Items go through the search in blocks of ``block`` term occurrences, each a pass
    over the documents. The sample of one document in ``one_in`` only sets where pruning starts.
    """
    small_batches(docs.sparkSession)
    texts = [
        df.select(F.col(key).cast("long").alias(name), F.col(text_col).cast("string").cast("binary").alias("text"))
        for df, key, name in ((docs, doc_id, "doc_id"), (items, item_id, "item_id"))
    ]
    each = texts[1].mapInArrow(item_terms, "item_id long, term binary").distinct()
    listed = each.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    out = None
    for ids, terms in blocks(listed, block):
        part = cut(block_top(texts[0], ids, terms, k, one_in))
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out
