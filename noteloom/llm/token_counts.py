"""Token counts by a finite-state transducer compiled from a byte-level BPE tokenizer.

A state holds what later bytes can still depend on: the class of the open pre-token,
white space or an apostrophe that waits for what follows, and for every place in the
pre-token from which a vocabulary entry may still run, the token that ends there and the
count up to there. Reading a byte leads to one next state and emits the change of the
count. A state's last token is the one vocabulary entry that ends here and that BPE
leaves beside the token before it, so no merge is replayed over the whole pre-token.

States and transitions are compiled as texts first need them and shared by all later
texts. A text is cut into chunks that are run side by side. A chunk's map takes entry states
to exit states and counts. Entry states to tabulate come from running up to the chunk from a
little before it, in two ways that mostly agree; the maps are composed by a parallel prefix
scan, and where the scan finds an entry state that a map lacks, the map gets it and the scan
goes on.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.packing import byte_alphabet
from noteloom.llm.tables import tokenizer_file

END, PAD = 256, 257
SHIFT = 9
#: The suffixes that the split rule takes with an apostrophe.
SHORT, LONG = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")


class CharClasses(dict):
    """``L`` letter, ``N`` number, ``P`` anything else or ``W`` white space, as the library's own split tells them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def __missing__(self, char: str) -> str:
        kind = next((k for k, lead in (("L", "a"), ("N", "1"), ("P", "!")) if len(self.split(lead + char)) == 1), "W")
        self[char] = kind
        return kind


class Bpe:
    """The vocabulary and merges, and which tokens may stand side by side."""

    def __init__(self, model: dict):
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.ranks}
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.beside: dict[tuple[bytes | None, bytes], bool] = {}

    def merge(self, text: bytes) -> list[bytes]:
        parts = [bytes([b]) for b in text]
        while len(parts) > 1:
            least, at = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if least == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, last: bytes | None, token: bytes) -> bool:
        """Whether BPE keeps ``token`` whole after ``last`` (or at the start of a pre-token)."""
        known = self.beside.get((last, token))
        if known is None:
            known = self.merge((last or b"") + token) == ([token] if last is None else [last, token])
            self.beside[last, token] = known
        return known


#: Starts in an open pre-token: (bytes since, token that ends there, count there less the count here).
FRESH = (b"", ((0, None, 0),))


class Transducer:
    def __init__(self, path: str, most_states: int = 250_000):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.special = [t["content"] for t in config["added_tokens"]]
        self.bpe, self.most_states, self.classes = Bpe(config["model"]), most_states, CharClasses(path)
        longest = max(map(len, self.bpe.tokens))  # counts in a state differ by no more, nor does a transition's
        self.bias = 1 << (SHIFT - 1)
        if longest + 2 >= self.bias or most_states >= 1 << (31 - SHIFT):
            raise ValueError("the vocabulary's tokens or the states are too many for the table")
        self.reset()

    def reset(self) -> None:
        self.states, self.number = [], {}
        self.column = np.full(258, -1, np.int64)
        self.n_columns = 0
        self.table = np.full((1024, 64), -1, np.int32)
        self.bpe.beside.clear()
        self.start = self.numbered(("S", FRESH, b"", b""))
        self.letter = self.numbered((*self.read("S", FRESH, b"", b"a", "L")[:3], b""))
        self.columns_for(np.array([END, PAD]))

    def numbered(self, state: tuple) -> int:
        k = self.number.get(state)
        if k is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return k

    def columns_for(self, symbols: np.ndarray) -> None:
        for s in symbols[self.column[symbols] < 0].tolist():
            if self.n_columns == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            self.column[s] = self.n_columns
            self.n_columns += 1

    def push(self, open_part: tuple, byte: int) -> tuple[tuple, int]:
        """The open pre-token with one byte more, and the change of its count."""
        since, starts = open_part
        byte_ = bytes([byte])
        token, delta, alive = None, 0, []
        for length, last, count in starts:
            run = since[len(since) - length :] + byte_
            if token is None and run in self.bpe.tokens and self.bpe.fits(last, run):
                token, delta = run, count + 1
            if run in self.bpe.prefixes:
                alive.append((length + 1, last, count))
        kept = [(n, last, count - delta) for n, last, count in alive]
        longest = max((n for n, _, _ in kept), default=0)
        text = since + byte_
        return (text[len(text) - longest :], (*kept, (0, token, 0))), delta

    def pushed(self, open_part: tuple, text: bytes) -> tuple[tuple, int]:
        total = 0
        for b in text:
            open_part, delta = self.push(open_part, b)
            total += delta
        return open_part, total

    def opened(self, lead: bytes, char: bytes, kind: str) -> tuple[str, tuple, bytes, int]:
        part, delta = self.pushed(FRESH, lead + char)
        return ("A" if char == b"'" and not lead else kind), part, b"", delta

    def read(self, mode: str, part: tuple, held: bytes, char: bytes, kind: str) -> tuple[str, tuple, bytes, int]:
        """One character: modes are S (none open), L, N, P, A (apostrophe first), B (and r, v or l), W."""
        if mode == "A":
            if char in SHORT:
                _, delta = self.pushed(part, char)
                return "S", FRESH, b"", delta
            if char in (b"r", b"v", b"l"):
                return "B", part, char, 0
            mode = "P"
        if mode == "B":
            if held + char in LONG:
                _, delta = self.pushed(part, held + char)
                return "S", FRESH, b"", delta
            mode, part, _, before = self.opened(b"", held, "L")
            mode, part, held, delta = self.read(mode, part, b"", char, kind)
            return mode, part, held, before + delta
        if mode == "W":
            if kind == "W":
                part, delta = self.pushed(part, held)
                return "W", part, char, delta
            if held == b" ":
                return self.opened(held, char, kind)
            before = self.pushed(FRESH, held)[1]
            mode, part, held, delta = self.opened(b"", char, kind)
            return mode, part, held, before + delta
        if kind == "W":
            return "W", FRESH, char, 0
        if kind == mode:
            part, delta = self.pushed(part, char)
            return mode, part, b"", delta
        return self.opened(b"", char, kind)

    def compile(self, state: int, symbol: int) -> None:
        """Fill in one transition."""
        mode, part, held, partial = self.states[state]
        if symbol == PAD:
            to, delta = self.states[state], 0
        elif symbol == END:
            delta = self.pushed(part if mode == "W" else FRESH, held)[1] if mode in "WB" else 0
            to = self.states[self.start]
        else:
            char, delta = partial + bytes([symbol]), 0
            need = 1 if char[0] < 0xC0 else 2 if char[0] < 0xE0 else 3 if char[0] < 0xF0 else 4
            if len(char) < need:
                to = (mode, part, held, char)
            else:
                mode, part, held, delta = self.read(mode, part, held, char, self.classes[char.decode("utf-8", "replace")])  # cut characters come up in guessed entries only
                to = (mode, part, held, b"")
        number = self.numbered(to)  # may enlarge the table
        self.table[state, self.column[symbol]] = number << SHIFT | (delta + self.bias)

    def advance(self, columns: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run every lane over its row of ``columns`` (steps by lanes); exit states and emitted counts."""
        counts = np.zeros(len(states), np.int64)
        symbol_of = np.empty(self.n_columns, np.int64)
        symbol_of[self.column[self.column >= 0]] = np.flatnonzero(self.column >= 0)
        for row in columns:
            value = self.table.ravel().take(states * self.table.shape[1] + row)
            if value.min() < 0:
                lack = np.flatnonzero(value < 0)
                for s, c in set(zip(states[lack].tolist(), row[lack].tolist(), strict=True)):
                    self.compile(s, int(symbol_of[c]))
                value = self.table.ravel().take(states * self.table.shape[1] + row)
            counts += value & (1 << SHIFT) - 1
            states = value >> SHIFT
        return states.astype(np.int64), counts - self.bias * len(columns)

    def run(self, state: int, symbols: np.ndarray) -> tuple[int, int]:
        """One lane, symbol by symbol."""
        total = 0
        for s in symbols.tolist():
            value = self.table[state, self.column[s]]
            if value < 0:
                self.compile(state, s)
                value = self.table[state, self.column[s]]
            total += (int(value) & (1 << SHIFT) - 1) - self.bias
            state = int(value) >> SHIFT
        return state, total

    def batched(self, symbols: np.ndarray, states: np.ndarray, lanes: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of rows of symbols; a few rows are run one by one."""
        if len(states) < 16:
            out = [self.run(int(s), row) for s, row in zip(states, symbols, strict=True)]
            return np.array([s for s, _ in out], np.int64), np.array([n for _, n in out], np.int64)
        leaves, total = np.empty(len(states), np.int64), np.empty(len(states), np.int64)
        for at in range(0, len(states), lanes):
            some = slice(at, at + lanes)
            leaves[some], total[some] = self.advance(np.ascontiguousarray(self.column[symbols[some]].T), states[some])
        return leaves, total

    def entries(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two guesses of the state after the symbols in ``before``: from no open pre-token, and from an open word."""
        inner = (before >= 0x80) & (before < 0xC0)
        before[np.logical_and.accumulate(inner, axis=1)] = PAD  # the rest of a cut character
        return tuple(self.batched(before, np.full(len(before), s))[0] for s in (self.start, self.letter))

    def counts(self, texts: list[bytes], chunk: int = 512, warm: int = 64) -> np.ndarray:
        """Tokens of each text; special strings are not looked for here."""
        if not texts:
            return np.empty(0, np.int64)
        if len(self.states) > self.most_states:
            self.reset()
        n_chunks = np.array([len(t) // chunk + 1 for t in texts])
        first = np.cumsum(n_chunks) - n_chunks
        symbols = np.full((int(n_chunks.sum()), chunk), PAD, np.uint16)
        flat = symbols.reshape(-1)
        for t, at in zip(texts, (first * chunk).tolist(), strict=True):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
            flat[at + len(t)] = END
        self.columns_for(np.flatnonzero(np.bincount(flat, minlength=258)))
        last = first + n_chunks - 1
        later = np.setdiff1d(np.arange(len(symbols)), first)
        one, two = self.entries(symbols[later - 1, max(0, chunk - warm) :])
        other = one != two
        where = np.concatenate([first, later, later[other]])
        enter = np.concatenate([np.full(len(first), self.start), one, two[other]])
        leave, total = self.batched(symbols[where], enter)
        heads = np.arange(len(first))
        done = np.isin(where, last)
        while True:
            key = where << 32 | enter
            order = np.argsort(key)
            want = (where + 1) << 32 | leave
            at = np.minimum(np.searchsorted(key, want, sorter=order), len(key) - 1)
            follow = np.where((key[order[at]] == want) & ~done, order[at], np.arange(len(key)))
            ends = follow == np.arange(len(key))
            sums = np.where(ends, 0, total)
            while not ends[follow].all():  # maps composed over ever longer runs of chunks
                sums, follow = sums + sums[follow], follow[follow]
            stop = follow[heads]
            open_ = np.unique(stop[~done[stop]])
            if not len(open_):
                return sums[heads] + total[stop]
            more, states = where[open_] + 1, leave[open_]
            out, n = self.batched(symbols[more], states)
            where, enter = np.r_[where, more], np.r_[enter, states]
            leave, total, done = np.r_[leave, out], np.r_[total, n], np.r_[done, np.isin(more, last)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, special strings in it counted as one token each."""
        pieces, owner, out = [], [], [0] * len(texts)
        for k, text in enumerate(texts):
            parts = [text]
            for s in self.special:
                if s in text:
                    split = [p.split(s) for p in parts]
                    out[k] += sum(len(p) - 1 for p in split)
                    parts = [x for p in split for x in p]
            for p in parts:
                if p:
                    pieces.append(p.encode("utf-8", "replace"))
                    owner.append(k)
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= 8 << 20):
                size += len(pieces[end])
                end += 1
            for k, n in zip(owner[at:end], self.counts(pieces[at:end]).tolist(), strict=True):
                out[k] += n
            at = end
        return out


@lru_cache(maxsize=1)
def compiled(path: str) -> Transducer:
    """A worker's transducer, kept over its tasks; it starts anew above ``most_states``."""
    return Transducer(path)


def counted(batches: Iterable[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    machine = compiled(path)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        counts = machine.count(texts)
        columns = [
            batch.column(0),
            pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array([n > limit for n in counts], pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, limit: int = 1024
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; no row is shuffled.

    A null or empty text has 0 bytes and tokens. Repeated rows, ties and null ids are
    kept as they are, other columns are not read, and an empty table gives no rows.
    """
    path = tokenizer_file("byte_bpe_50k.json", tokenizer_path)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return chosen.mapInArrow(lambda it: counted(it, path, limit), schema)
