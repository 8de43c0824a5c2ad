"""Benchmark decontamination: an FM-index per shard of documents, searched for benchmark phrases.

The documents stay where they are: each task indexes the words of its own documents,
shard by shard, and searches the index for every phrase of the benchmark. Only the
benchmark travels, in blocks of a bounded number of bytes; a benchmark of several
blocks is searched block after block over the same rows, in one pass without a shuffle.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.llm.fm_index import FMIndex
from noteloom.llm.tables import giving_back

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = "array<struct<start:int,end:int>>"
ADDED = {"n_words": "long", "n_hit": "long", "hit_items": "array<string>", "hit_words": SPAN}
ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "hit_items": pa.list_(pa.string()), "hit_words": ARROW_SPAN}


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered; every character beyond ASCII is part of a word."""
    return WORDS.findall((text or "").encode("utf-8", "replace").lower())


class Phrases:
    """The windows of benchmark items as rows of symbols, by length, each with its items."""

    def __init__(self, items: Iterable[tuple[str, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        rows: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        self.items: list[str | None] = []
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                length = min(width, len(ids))
                found = np.lib.stride_tricks.sliding_window_view(ids, length)
                rows[length].append(found)
                owners[length].append(np.full(len(found), len(self.items), np.int32))
            self.items.append(item)
        self.groups = []
        for length in sorted(rows):
            windows, which = np.unique(np.concatenate(rows.pop(length)), axis=0, return_inverse=True)
            pairs = np.unique(np.c_[which.ravel(), np.concatenate(owners.pop(length))], axis=0)
            ends = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
            self.groups.append((length, windows, pairs[:, 1], ends))

    def hits(self, texts: list[list[bytes]], sample: int) -> list[tuple[np.ndarray, set[str]]]:
        """For each document of the shard, which words lie in an occurrence, and the items that occur."""
        get, ends, parts = self.vocabulary.get, [], []
        total = 0
        for words in texts:
            parts.append(np.array([get(w, 0) for w in words] + [0], np.int64))
            total += len(words) + 1
            ends.append(total)
        cover, found = np.zeros(total + 1, np.int64), [set() for _ in texts]
        index = FMIndex(np.concatenate(parts), len(self.vocabulary) + 1, sample)
        for length, windows, owners, bounds in self.groups:
            patterns = windows.astype(np.int64)
            low, high = index.search(patterns)
            counts = high - low
            which = np.repeat(np.arange(len(patterns)), counts)
            rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            docs = np.searchsorted(ends, at, side="right")
            for pair in np.unique(docs * len(patterns) + which):
                k = pair % len(patterns)
                found[pair // len(patterns)].update(owners[bounds[k] : bounds[k + 1]].tolist())
        hit = np.cumsum(cover)[:-1] > 0
        named = [{self.items[i] for i in some} - {None} for some in found]
        return [(x[:-1], items) for x, items in zip(np.split(hit, ends[:-1]), named, strict=True)]


@lru_cache(maxsize=2)
def phrases_of(block: bytes, width: int) -> Phrases:
    """A worker's phrases of one block of items, kept over its tasks."""
    return Phrases(json.loads(zlib.decompress(block)), width)


def spans_of(hit: np.ndarray) -> list[dict]:
    """The merged runs of hit words, as word numbers, end exclusive."""
    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist()
    return [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def scanned(
    batches: Iterable[pa.RecordBatch], text_col: str, block: bytes, width: int, shard_words: int, sample: int
) -> Iterator[pa.RecordBatch]:
    """The rows with what this block of phrases adds to what earlier blocks found."""
    phrases = phrases_of(block, width)
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index(text_col)).to_pylist()
        earlier = [batch.column(names.index(c)).to_pylist() if c in names else None for c in ("hit_items", "hit_words")]
        rows: dict[str, list] = {c: [] for c in ADDED}
        shard: list[list[bytes]] = []

        def flush(shard=shard, rows=rows, earlier=earlier) -> None:
            for words, (hit, items) in zip(shard, phrases.hits(shard, sample), strict=True):
                k = len(rows["n_words"])
                if earlier[0] is not None:
                    items = items | set(earlier[0][k])
                    for s in earlier[1][k]:
                        hit[s["start"] : s["end"]] = True
                rows["n_words"].append(len(words))
                rows["n_hit"].append(int(hit.sum()))
                rows["hit_items"].append(sorted(items))
                rows["hit_words"].append(spans_of(hit))
            shard.clear()

        size = 0
        for text in texts:
            words = words_of(text)
            if shard and size + len(words) > shard_words:
                flush()
                size = 0
            shard.append(words)
            size += len(words) + 1
        if shard:
            flush()
        kept = [c for c in names if c not in ADDED]
        columns = [batch.column(names.index(c)) for c in kept] + [pa.array(rows[c], ARROW[c]) for c in ADDED]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, *ADDED])


def without_spans(batches: Iterable[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index(text_col)
        texts = batch.column(at).to_pylist()
        for k, spans in enumerate(batch.column(batch.schema.names.index("hit_words")).to_pylist()):
            if spans:
                raw = texts[k].encode("utf-8", "replace")
                places, out, last = [m.span() for m in WORDS.finditer(raw.lower())], [], 0
                for s in spans:
                    out.append(raw[last : places[s["start"]][0]])
                    last = places[s["end"] - 1][1]
                texts[k] = b"".join([*out, raw[last:]]).decode()
        yield batch.set_column(at, batch.schema.names[at], pa.array(texts, batch.schema.field(at).type))


def removing(
    batches: Iterable[pa.RecordBatch], text_col: str, block: bytes, width: int, shard_words: int, sample: int
) -> Iterator[pa.RecordBatch]:
    yield from without_spans(scanned(batches, text_col, block, width, shard_words, sample), text_col)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    shard_words: int = 1 << 19,
    sample: int = 8,
    block_bytes: int = 4 << 20,
    remove: bool = False,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_items`` and ``hit_words`` (spans of word numbers).

    A phrase is ``width`` consecutive words of an item; an item of fewer words is one
    phrase, an item without words none. A null text has no words and no hits; the
    windows of an item with a null id hit like any other, but the item is not listed. Repeated rows are each scanned; an item that repeats counts
    once; columns of ``docs`` with the names added here are replaced. The
    benchmark is small beside the documents; its items go to the tasks as compressed text in
    blocks of ``block_bytes``, which workers turn into phrases. All blocks are searched, one
    after the other, and the plan holds the compressed text of all of them. With ``remove`` the hit spans are cut out
    of the texts, in the same pass; other texts are unchanged.
    """
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("words")
    ).where("words is not null")
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    found = docs.drop(*ADDED)
    kept = [T.StructField(f.name, f.dataType, True) for f in found.schema]
    added = [T.StructField(c, T._parse_datatype_string(kind), True) for c, kind in ADDED.items()]
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == k).distinct().collect()
        block = zlib.compress(json.dumps([(r.item, r["words"]) for r in rows]).encode())
        work = removing if remove and k == n_blocks - 1 else scanned
        run = lambda it, f=work, b=block: giving_back(f, it, text_col, b, width, shard_words, sample)
        found = found.mapInArrow(run, T.StructType(kept + added))
    return found
