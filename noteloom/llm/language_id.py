"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A text's
probability under a language is the product over its words of the sum over all ways to
cut the word into pieces, which a forward pass computes. The piece probabilities come
from expected counts over all segmentations (forward-backward) of a bounded sample.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.tables import giving_back, tokenizer_file

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Longer words are summed as logarithms from the start, which is only a matter of time: so are shorter ones whose sum comes below ``LOWEST``.
LONGEST = 40
LOWEST = 1e-280
UNKNOWN = 1e-7
#: Pieces and spans of words are compared by polynomials of their characters modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MARKS = ".,;:!?$%&*#|\"'()"


def words_of(chunk: str) -> list[str]:
    return [MARK + word for word in LETTERS.findall(chunk)]


def vocabulary(path: str) -> dict[str, int]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            pieces.setdefault(model.id_to_piece(k), len(pieces))
    return pieces


Span = tuple[int, int, np.ndarray, np.ndarray]


class Lattice:
    """Forward and backward passes over many words of one length at a time."""

    def __init__(self, pieces: dict[str, int]):
        self.unknown = len(pieces)
        self.most = max(map(len, pieces), default=1)
        keys = np.array([self.key(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], np.array(list(pieces.values()), np.int64)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces of the vocabulary have the same key")

    @staticmethod
    def key(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * BASE + ord(c) + 1) % 2**64
        return value

    def by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, list[Span]]]:
        """Words of one length, and by start and end those that have a piece there, with the piece.

        A single character that is no piece is the unknown one.
        """
        groups: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            if len(w) <= LONGEST + 1:
                groups[len(w)].append(k)
        for length, rows in groups.items():
            codes = np.array([words[k] for k in rows], f"<U{length}").view(np.uint32).reshape(-1, length).astype(np.uint64) + np.uint64(1)
            spans: list[Span] = []
            for start in range(length):
                keys = np.zeros(len(rows), np.uint64)
                for end in range(start + 1, min(length, start + self.most) + 1):
                    keys = keys * np.uint64(BASE) + codes[:, end - 1]
                    at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
                    hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(rows), bool)
                    if end == start + 1:
                        spans.append((start, end, np.arange(len(rows)), np.where(hit, self.numbers[at] if len(self.keys) else 0, self.unknown)))
                    elif hit.any():
                        spans.append((start, end, np.flatnonzero(hit), self.numbers[at[hit]]))
            yield np.array(rows), length, spans

    def forward(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Log probability of each word under each column of ``table`` (pieces and unknown by languages)."""
        out = np.zeros((len(words), table.shape[1]))
        low: list[int] = []
        for rows, length, spans in self.by_length(words):
            sums = self.alphas(len(rows), length, spans, table)[length]
            out[rows] = np.log(np.maximum(sums, LOWEST))
            low += rows[(sums < LOWEST).any(axis=1)].tolist()
        for k in [*low, *self.long(words)]:
            out[k] = self.log_sums(len(words[k]), self.pieces_in(words[k]), np.log(table))[-1]
        return out

    @staticmethod
    def long(words: list[str]) -> list[int]:
        return [k for k, w in enumerate(words) if len(w) > LONGEST + 1]

    def pieces_in(self, word: str) -> np.ndarray:
        """``start, end, piece`` of every piece in one word, sorted by end."""
        codes = np.array([word]).view(np.uint32).astype(np.uint64) + np.uint64(1)
        keys, out = np.zeros(len(codes), np.uint64), []
        for size in range(1, min(len(codes), self.most) + 1):
            keys = keys[: len(codes) - size + 1] * np.uint64(BASE) + codes[size - 1 :]
            at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
            starts = np.arange(len(keys)) if size == 1 else np.flatnonzero(hit)
            ids = np.where(hit, self.numbers[at] if len(self.keys) else 0, self.unknown)[starts]
            out.append(np.c_[starts, starts + size, ids])
        out = np.concatenate(out)
        return out[np.argsort(out[:, 1], kind="stable")]

    @staticmethod
    def log_sums(length: int, spans: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all segmentations up to each place of one word; spans are sorted by end."""
        out = np.full((length + 1, logs.shape[1]), -np.inf)
        out[0] = 0
        bounds = np.searchsorted(spans[:, 1], np.arange(length + 2))
        for end in range(1, length + 1):
            some = spans[bounds[end] : bounds[end + 1]]
            ways = out[some[:, 0]] + logs[some[:, 2]]
            top = ways.max(axis=0)
            out[end] = top + np.log(np.exp(ways - top).sum(axis=0))
        return out

    def alphas(self, n: int, length: int, spans: list[Span], table: np.ndarray) -> np.ndarray:
        alpha = np.zeros((length + 1, n, table.shape[1]))
        alpha[0] = 1
        for start, end, some, ids in spans:
            alpha[end][some] += alpha[start][some] * table[ids]
        return alpha

    def expected(self, words: list[str], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected piece counts of words that occur ``counts`` (words by languages) times."""
        total, low = np.zeros_like(table), []
        for rows, length, spans in self.by_length(words):
            alpha = self.alphas(len(rows), length, spans, table)
            small = (alpha[length] < LOWEST).any(axis=1)
            low += rows[small].tolist()
            beta = np.zeros_like(alpha)
            beta[length] = 1
            for start, end, some, ids in reversed(spans):
                beta[start][some] += beta[end][some] * table[ids]
            scale = np.where(small[:, None], 0.0, counts[rows] / np.maximum(alpha[length], LOWEST))
            for start, end, some, ids in spans:
                np.add.at(total, ids, alpha[start][some] * table[ids] * beta[end][some] * scale[some])
        for k in [*low, *self.long(words)]:
            spans, logs, length = self.pieces_in(words[k]), np.log(table), len(words[k])
            alpha = self.log_sums(length, spans, logs)
            turned = np.c_[length - spans[:, 1], length - spans[:, 0], spans[:, 2]]
            beta = self.log_sums(length, turned[np.argsort(turned[:, 1], kind="stable")], logs)[::-1]
            share = np.exp(alpha[spans[:, 0]] + logs[spans[:, 2]] + beta[spans[:, 1]] - alpha[length])
            np.add.at(total, spans[:, 2], share * counts[k])
        return total


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, int]
    table: np.ndarray


def learn(words: list[tuple[str, str, int]], pieces: dict[str, int], rounds: int = 2, smooth: float = 0.05) -> Model:
    """A model from ``(language, word, count)``; languages in alphabetical order."""
    languages = sorted({lang for lang, _, _ in words})
    lattice, column = Lattice(pieces), {x: k for k, x in enumerate(languages)}
    distinct = sorted({w for _, w, _ in words})
    row = {w: k for k, w in enumerate(distinct)}
    counts = np.zeros((len(distinct), len(languages)))
    for lang, word, n in words:
        counts[row[word], column[lang]] += n
    table = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    table[-1] = UNKNOWN
    for _ in range(rounds):
        total = lattice.expected(distinct, counts, table)[:-1] + smooth
        table[:-1] = total / total.sum(axis=0)
    return Model(languages, pieces, table)


class Scorer:
    """Languages of texts, by a cache over white-space chunks that starts anew when full."""

    def __init__(self, model: Model, most: int = 250_000):
        self.model, self.lattice, self.most = model, Lattice(model.pieces), most
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}  # a row of ``scores`` for each chunk; row 0 is for no letters
        self.scores = np.zeros((1024, len(self.model.languages)))
        self.n_rows = 1

    def add(self, chunks: set[str]) -> None:
        """Rows for new chunks: one for each bare word, shared by its forms with marks, one for each other chunk."""
        bare = {c: c if c.isalpha() else c.strip(MARKS) for c in chunks}
        fresh = sorted({b for b in bare.values() if b and b not in self.number})
        parts = [[MARK + b] if b.isalpha() else words_of(b) for b in fresh]
        words = sorted({w for p in parts for w in p})
        found = dict(zip(words, self.lattice.forward(words, self.model.table), strict=True))
        while self.n_rows + len(fresh) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        for b, part in zip(fresh, parts, strict=True):
            if part:
                self.number[b] = self.n_rows
                self.scores[self.n_rows] = found[part[0]] if len(part) == 1 else sum(found[w] for w in part)
                self.n_rows += 1
            else:
                self.number[b] = 0
        for c, b in bare.items():
            self.number[c] = self.number[b] if b else 0

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        for at in range(0, len(texts), 1000):
            chunks = [(t or "").lower().split() for t in texts[at : at + 1000]]
            if len(self.number) > self.most:
                self.reset()
            lack = {c for x in chunks for c in x if c not in self.number}
            if lack:
                self.add(lack)
            for x in chunks:
                rows = np.array([self.number[c] for c in x], np.int64)
                if not self.model.languages or not rows.any():
                    yield "und", 0.0
                    continue
                score = self.scores[rows].sum(axis=0)
                shares = np.exp((score - score.max()) / np.count_nonzero(rows))
                best = int(score.argmax())
                yield self.model.languages[best], float(shares[best] / shares.sum())


def predicted(batches: Iterable[pa.RecordBatch], model: Model, text_col: str) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        names = batch.schema.names
        out = list(scorer(batch.column(names.index(text_col)).to_pylist()))
        columns = [pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())]
        keep = [n for n in names if n not in ("lang_pred", "score")]
        yield pa.RecordBatch.from_arrays([batch.column(names.index(n)) for n in keep] + columns, names=[*keep, "lang_pred", "score"])


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_language: int = 400, most_chars: int = 1 << 20, vocabulary_path: str | None = None,
) -> Model:
    """A model from the whole texts of at most ``docs_per_language`` documents of each non-null language.

    They are the ones whose ids have the least hashes, of texts of at most ``most_chars``
    characters; the driver sees their word counts. With these two bounds it holds no more than
    ``docs_per_language * most_chars`` characters a language, whatever the table.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(F.col(text_col).cast("string")) <= most_chars)).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    named = rows.select("id", "lang", (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40)).alias("draw"))
    sizes = named.groupBy("lang").agg(F.count("*").alias("n"))
    likely = named.join(F.broadcast(sizes), "lang").where(F.col("draw") * F.col("n") <= 2 * docs_per_language)  # few rows a language; sizes has one
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    chosen = likely.withColumn("place", place).where(F.col("place") <= docs_per_language).select("id", "lang").distinct()
    some = rows.join(F.broadcast(chosen), ["id", "lang"])
    chunks = some.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("chunk")).groupBy("lang", "chunk").count()
    words = [(r.lang, w, r["count"]) for r in chunks.collect() for w in words_of(r.chunk)]
    return learn(words, vocabulary(tokenizer_file("piece_bpe_32k.model", vocabulary_path)))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the language's share of the probability of a typical word.

    All words decide the language; the score takes their mean log probability, so it tells
    close calls from clear ones also in long texts.

    A null text or one without letters, and every text if nothing was learned, is ``und``
    with score 0. Ties go to the language that sorts first. Other columns are kept, those
    with these names replaced; repeated rows are scored alike.
    """
    schema = docs.drop("lang_pred", "score").schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(lambda it: giving_back(predicted, it, model, text_col), schema)
