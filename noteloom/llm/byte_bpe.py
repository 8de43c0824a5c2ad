"""Byte-level BPE by overlapping chunks, and back.

Texts of more than ``CHUNK`` bytes are cut into chunks that overlap by ``OVERLAP`` bytes and
are pre-tokenised side by side, each from its own first character. Where two neighbours both
begin a pre-token at the same place of their overlap they agree from there on, so that place
is a true boundary if the earlier chunk's are. The stretches between such places are then
encoded side by side, and their ids put together in order. Only places travel to the stitching,
never texts. A border at which no place agrees (a pre-token longer than the overlap) leaves
the rest of that text one stretch, encoded whole. Texts of one chunk need none of
this and are encoded where they are read, without a shuffle. Decoding concatenates the raw
bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.tables import batches_of, giving_back, small_batches, tokenizer_file
from noteloom.session import cut

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: No alternative of the split rule looks further than this beyond where it may end.
MARGIN = 3
CHUNKS = "key string, k long, begin long, own long, chunk binary, heads array<long>, tails array<long>, last boolean"
PARTS = "key string, k long, span long, lo long, hi long"
ROWS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=1)
def unassigned() -> str:
    """A regular expression's class of the code points without a meaning in Python's Unicode tables.

    Libraries of other Unicode releases may count these as letters or not; the classes of
    all others are settled.
    """
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    starts = [c for i, c in enumerate(points) if not i or points[i - 1] != c - 1]
    ends = [c for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
    return "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(starts, ends, strict=True)) + "]"


class Codec:
    """Encoding and decoding by a file of ranks, and the places where pre-tokens begin."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.raw = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: b"%d" % rank for rank in self.raw}
        self.pieces = regex.compile(pattern).finditer
        self.unsettled = regex.compile(unassigned()).search

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def listed(self, ids: Iterable[int]) -> bytes:
        return b" ".join(map(self.decimal.__getitem__, ids))

    def starts(self, text: str, ends_here: bool) -> list[int]:
        """Where pre-tokens of ``text`` begin behind something other than white space, or at its start.

        Neither what may follow the text changes these places, nor does a cut there change the
        pre-tokens before it, as one behind white space could. In a text with unsettled code
        points only the places count that begin a pre-token whatever those are: white space
        behind something else.
        """
        most = len(text) - (0 if ends_here else MARGIN)
        found = [p for p in (m.start() for m in self.pieces(text)) if p <= most and not (p and text[p - 1].isspace())]
        if self.unsettled(text):
            found = [p for p in found if p and text[p] in " \t\n\r\v\f"]
        return found


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def text_of(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def whole_texts(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = codec(path, pattern)
    for batch in batches:
        rows = [], [], []
        for raw in batch.column(1).to_pylist():
            ids = bpe.encode(text_of(raw))
            for column, value in zip(rows, (len(ids), hashlib.sha256(bpe.listed(ids)), hashlib.sha256(bpe.decode(ids))), strict=True):
                column.append(value if isinstance(value, int) else value.hexdigest())
        yield batches_of(ROWS, batch.column(0), *rows)


def char_start(raw: bytes, at: int) -> int:
    """The last place up to ``at`` where a character begins."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return min(at, len(raw))


def chunked(batches: Iterable[pa.RecordBatch], path: str, pattern: str, size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks with the places of pre-tokens in both overlaps, as bytes of the whole text; one batch a chunk."""
    bpe = codec(path, pattern)

    def places(own: str, found: list[int], base: int) -> list[int]:
        at, before, out = base, 0, []
        for p in found:
            at, before = at + len(own[before:p].encode()), p
            out.append(at)
        return out

    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text_of(raw).encode()
            begin, k = 0, 0
            while begin < len(raw):
                end = char_start(raw, begin + size)
                stop = char_start(raw, end + overlap)
                own, beyond = raw[begin:end].decode(), raw[end:stop].decode()
                found = bpe.starts(own + beyond, stop == len(raw))
                near = [p for p in found if p < overlap]
                heads = [p for p in places(own + beyond, near, begin) if p < begin + overlap] if k else [0]
                tails = places(beyond, [p - len(own) for p in found if p >= len(own)], end)
                yield batches_of(CHUNKS, [key], [k], [begin], [end - begin], [raw[begin:stop]], [heads], [tails], [end == len(raw)])
                begin, k = end, k + 1


def stitched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which bytes of which chunk belong to which stretch, from the overlaps of each text's chunks in order."""
    held = None  # key, k, span, lo, end of the chunk's own bytes, tails, whether all borders agreed so far
    for batch in batches:
        out = []
        for key, k, begin, own, heads, tails, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            span, lo, agreed = k, begin, True
            if held and held[0] == key:
                _, k0, span0, lo0, end0, tails0, agreed = held
                common = set(tails0).intersection(heads) if agreed else ()
                agreed = bool(common)
                span, lo = (k, min(common)) if agreed else (span0, begin)
                out.append((key, k0, span0, lo0, lo if agreed else end0))
            held = (key, k, span, lo, begin + own, tails, agreed)
            if last:
                out.append((key, k, span, lo, begin + own))
        if out:
            yield batches_of(PARTS, *zip(*out, strict=True))


def encoded(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """The ids of each stretch, whose parts come in order."""
    bpe, schema = codec(path, pattern), "key string, span long, ids binary"
    held, parts = None, []

    def done() -> pa.RecordBatch:
        ids = bpe.encode(b"".join(parts).decode())
        return batches_of(schema, [held[0]], [held[1]], [np.asarray(ids, "<u4").tobytes()])

    for batch in batches:
        for key, span, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (key, span) != held:
                if held:
                    yield done()
                held, parts = (key, span), []
            parts.append(part)
    if held:
        yield done()


def folded(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Digests of each text from the ids of its stretches in order; keeps no ids."""
    bpe = codec(path, pattern)
    schema = "key string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    held = None

    def done() -> pa.RecordBatch:
        return batches_of(schema, [held[0]], [held[1]], [held[2].hexdigest()], [held[3].hexdigest()])

    for batch in batches:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.frombuffer(raw, "<u4").tolist()
            if not held or held[0] != key:
                if held:
                    yield done()
                held = [key, 0, hashlib.sha256(), hashlib.sha256()]
            held[2].update((b" " if held[1] and ids else b"") + bpe.listed(ids))
            held[3].update(bpe.decode(ids))
            held[1] += len(ids)
    if held:
        yield done()


def encode_long(texts: DataFrame, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """``key, span, ids`` of distinct ``texts (key, text)``: the ids of the stretches in order of ``span``.

    Copies of a text are one from the chunks on. ``ids`` holds unsigned 32-bit little-endian numbers.
    """
    made = texts.select("key", "text").mapInArrow(lambda it: giving_back(chunked, it, path, pattern, size, overlap), CHUNKS)
    chunks = cut(made.dropDuplicates(["key", "k"]))
    borders = chunks.select("key", "k", "begin", "own", "heads", "tails", "last").repartition("key").sortWithinPartitions("key", "k")
    parts = borders.mapInArrow(stitched, PARTS).join(chunks.select("key", "k", "begin", "chunk"), ["key", "k"])
    part = F.expr("substring(chunk, cast(lo - begin + 1 as int), cast(hi - lo as int))").alias("part")
    ordered = parts.select("key", "span", "k", part).repartition("key", "span").sortWithinPartitions("key", "span", "k")
    return ordered.drop("k").mapInArrow(lambda it: giving_back(encoded, it, path, pattern), "key string, span long, ids binary")


def digests(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    pattern: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``ROWS``: how many ids each text has, the digest of the ids and that of the bytes they decode to.

    Every row gives one row, in which other columns are not kept: a null or empty text has no
    ids, so both digests are of nothing; repeated rows and repeated or null ids each give their
    own row; an empty table gives none. Bytes that are not UTF-8 count as U+FFFD. Special
    strings in a text are ordinary text.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = tokenizer_file("byte_bpe_50k.tiktoken", ranks_path)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    short = rows.where(~is_long).mapInArrow(lambda it: giving_back(whole_texts, it, path, pattern), ROWS)
    named = rows.where(is_long).withColumn("key", F.sha2("text", 256))
    pieces = encode_long(named, path, pattern, chunk, overlap).repartition("key").sortWithinPartitions("key", "span")
    found = pieces.drop("span").mapInArrow(
        lambda it: giving_back(folded, it, path, pattern), "key string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return short.unionByName(named.select("doc_id", "key").join(found, "key").drop("key"))


def encode(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` (null for a null text), for texts that one task may hold."""
    return _column(docs, F.col(text_col).cast("string"), "ids", "array<long>", pa.list_(pa.int64()), lambda bpe, t: bpe.encode(t), ranks_path, pattern)


def decode(docs: DataFrame, ids_col: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with the column ``decoded``: the raw bytes of the ids, null for null."""
    return _column(docs, F.col(ids_col), "decoded", "binary", pa.binary(), lambda bpe, ids: bpe.decode(ids), ranks_path, pattern)


def _column(docs, value, name, kind, arrow, made, ranks_path, pattern) -> DataFrame:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = tokenizer_file("byte_bpe_50k.tiktoken", ranks_path)
    small_batches(docs.sparkSession)

    def column(values: pa.Array) -> pa.Array:
        bpe = codec(path, pattern)
        return pa.array([None if v is None else made(bpe, v) for v in values.to_pylist()], arrow)

    return docs.withColumn(name, F.arrow_udf(column, kind)(value))
