"""Packing tokenized documents into fixed windows by minimum bin slack.

Each task tokenizes the documents of its own input split and packs them, so no row
is shuffled. A document is cut into full windows, which need no partner, and one
remainder. The remainders wait as a histogram of lengths; for each window the longest
remaining one is fixed and a subset-sum dynamic program over a bitset picks the
multiset of the others that comes closest to the capacity. The bitset after each kind
of item is kept, so walking back through them gives how many of each length to take.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.tables import giving_back, tokenizer_file

#: The split rule of the word-level BPE file.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in keep}, 0x100
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


class ChunkEncoder:
    """Token ids of texts, as the library gives them, by caching white-space chunks.

    The tokenizer drops white space and no rule of it looks across ASCII white space,
    so a text's ids are those of its chunks in order. Chunks of plain Latin letters go
    through the library's BPE model piece by piece, all others through its whole chain.
    The cache holds at most ``most`` chunks and then starts anew.
    """

    def __init__(self, path: str, most: int = 250_000):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.pieces = regex.compile(PRETOKEN).findall
        self.plain = regex.compile(r"[!-~¡-įı-ɏ]+").fullmatch
        #: Ends of words that are letters to every release of Unicode and stay single when lowered.
        self.letter = regex.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏͰ-ͳΑ-ΡΣ-ωЀ-ҁҊ-ԯא-תぁ-ゖァ-ヺ一-龥가-힣]\Z").search
        self.alphabet = byte_alphabet()
        self.written = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.most = most
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return b"".join([self.written[i] for i in self.library.encode(text, add_special_tokens=False).ids])

    def piece(self, text: str) -> bytes:
        mapped = text if text.isascii() else "".join([self.alphabet[b] for b in text.encode()])
        return b"".join([self.written[t.id] for t in self.model.tokenize(mapped)])

    def chunk(self, raw: bytes) -> bytes:
        """The ids of a chunk that is not in the cache; letters and the marks after them are kept apart."""
        if len(self.known) >= self.most:
            self.known.clear()
        bare = raw.rstrip(b".,;:!?$%&*#|")
        if bare and len(bare) < len(raw) and self.letter(bare[-4:].decode(errors="ignore")):
            mark = raw[len(bare) :]
            ids = (self.known.get(bare) or self.chunk(bare)) + (self.known.get(mark) or self.chunk(mark))
        else:
            text = raw.decode()
            if not self.plain(text):
                ids = self.whole(text)
            elif text.isalpha():
                ids = self.piece(text.lower())
            else:
                ids = b"".join([self.piece(x) for x in self.pieces(text.lower())])
        self.known[raw] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if "<|" in text:  # special strings are found before letters are lowered
            return self.whole(text)
        known, chunk = self.known.get, self.chunk
        return b"".join([known(c) or chunk(c) for c in text.encode("utf-8", "replace").lower().split()])


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum is nearest to ``room`` from below."""
    reach, mask, trail = 1, (1 << (room + 1)) - 1, []
    full = 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            trail.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
            if reach & full:
                break
        if reach & full:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(trail):
        if not before >> total & 1:
            total -= length * take
            used[length] += take
    return dict(used)


def windows(counts: dict[int, int], capacity: int) -> Iterator[dict[int, int]]:
    """Windows, each a multiset of lengths, until the histogram is empty."""
    counts = dict(counts)
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        used = fill(rest, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        for _ in range(min(counts[x] // n for x, n in used.items())):
            yield used
            for x, n in used.items():
                counts[x] -= n
        for x in used:
            if not counts[x]:
                del counts[x]


def packed(
    batches: Iterable[pa.RecordBatch], path: str, capacity: int, end_id: int, waiting: int, group_col: str | None = None
) -> Iterator[pa.RecordBatch]:
    """One task's pieces. At most ``waiting`` remainders wait at a time, so memory is bounded.

    A third column is the group of each document, with which its pieces end.
    """
    encode, end = ChunkEncoder(path), end_id.to_bytes(4, "little")
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    made, rows = 0, []
    remainders: dict[str | None, dict[int, list[tuple]]] = defaultdict(lambda: defaultdict(list))
    n_waiting = 0
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * len(names)
    if group_col is not None:
        names, kinds = [*names, group_col], [*kinds, pa.string()]

    def flush() -> None:
        nonlocal made, n_waiting
        for group, mine in remainders.items():
            end_of = () if group_col is None else (group,)
            for used in windows({k: len(v) for k, v in mine.items()}, capacity):
                offset = 0
                for length in sorted(used, reverse=True):
                    for _ in range(used[length]):
                        rows.append((*mine[length].pop(), first + made, offset, *end_of))
                        offset += length
                made += 1
        remainders.clear()
        n_waiting = 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        rows.clear()
        return batch

    for batch in batches:
        groups = [None] * batch.num_rows if group_col is None else batch.column(2).to_pylist()
        for doc_id, text, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), groups, strict=True):
            ids = encode(text or "") + end
            n, start = len(ids) // 4, 0
            while n - start >= capacity:
                piece = ids[4 * start : 4 * (start + capacity)]
                rows.append((doc_id, start, capacity, zlib.crc32(piece), n, first + made, 0, *(() if group_col is None else (group,))))
                made, start = made + 1, start + capacity
            if start < n:
                remainders[group][n - start].append((doc_id, start, n - start, zlib.crc32(ids[4 * start :]), n))
                n_waiting += 1
                if n_waiting >= waiting:
                    flush()
            if len(rows) >= 50_000:
                yield out()
    flush()
    yield out()


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    tokenizer_path: str | None = None,
    end_id: int = 1,
    waiting: int = 65_536,
    group_col: str | None = None,
) -> DataFrame:
    """The pieces of every document and their places in windows of ``capacity`` tokens.

    A null or empty text is the end token alone. Every row is packed by itself, so
    repeated rows and repeated or null ids each get their own pieces; an empty table
    gives no rows. Other columns are not read. Remainders wait in groups of ``waiting``
    (default 65,536) at most: that bounds a task's memory and costs one part-filled
    window a group. Window numbers are the task's number shifted left by 33 bits plus a
    count, so they are unique over the table. Where ``group_col`` is given no window holds
    pieces of two of its values, nulls being one, and the pieces end with it, as text; each
    value then leaves part-filled windows of its own.
    """
    path = tokenizer_file("word_bpe_49k.json", tokenizer_path)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if group_col is None:
        return chosen.mapInArrow(lambda it: giving_back(packed, it, path, capacity, end_id, waiting), SCHEMA)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(group_col).cast("string").alias(group_col))
    return chosen.mapInArrow(lambda it: giving_back(packed, it, path, capacity, end_id, waiting, group_col), f"{SCHEMA}, `{group_col}` string")
