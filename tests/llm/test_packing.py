import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.llm import packing
from noteloom.llm.tables import tokenizer_file

TEXTS = [
    "Don't STOP, it's 42 o'clock!!",
    "",
    None,
    " \n\t ",
    "İstanbul ΣΑΣ x²½ 你好, é! ﬁ Ⅷ ١٢ á",
    "a<|endoftext|>B\x1cc <|ENDOFTEXT|>",
    "the und der " * 3000,
    "same", "same",
]


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    encode, library = packing.ChunkEncoder(path), Tokenizer.from_file(path)
    for text in filter(None, TEXTS):
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts_and_of_letters_that_grow_when_lowered():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    rng, encode, library = random.Random(6), packing.ChunkEncoder(path), Tokenizer.from_file(path)
    texts = ["İKİ, üç", "BİTTİ. SON", "TÜRKİYE'DEKİ!", "İ", "İ.", "a\u0307,", "\ua7da,", "가. 你, ω; ς! Σ. Ά?"]
    kinds = ["İIıiŞşé.,;:!?'", "abcXYZ .,!?'\"()0123", "你好가나ωΣЖж.,!? ", "".join(chr(rng.randrange(1, 0x3000)) for _ in range(400)) + " .,!"]
    texts += ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(1, 30))) for _ in range(30_000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    for text, ids in zip(texts, want, strict=True):
        assert encode(text) == ids, text


def test_small_cache_changes_nothing():
    path = tokenizer_file("word_bpe_49k.json")
    small, large = packing.ChunkEncoder(path, most=2), packing.ChunkEncoder(path)
    assert all(small(t) == large(t) for t in filter(None, TEXTS))


def best(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


@pytest.mark.parametrize("seed", range(20))
def test_fill_is_the_best_subset_sum(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, rng.integers(1, 12)).tolist()
    counts = {x: lengths.count(x) for x in lengths}
    used = packing.fill(counts, 100)
    assert all(n <= counts[x] for x, n in used.items())
    assert sum(x * n for x, n in used.items()) == best(lengths, 100)


def test_windows_hold_each_item_once():
    counts = {5: 7, 3: 4, 10: 2, 1: 1}
    made = list(packing.windows(counts, 10))
    for x, n in counts.items():
        assert sum(w.get(x, 0) for w in made) == n
    assert all(sum(x * n for x, n in w.items()) <= 10 for w in made)


def test_pieces_cover_every_document(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, length int")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    out = packing.pack(docs).toPandas()
    for doc_id, text, *_ in rows[:-1]:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        got = out[out.doc_id == doc_id].sort_values("start")
        assert got.start.tolist() == [0, *got.length.cumsum().tolist()[:-1]]
        assert got.length.sum() == len(ids) and set(got.doc_tokens) == {len(ids)}
        for p in got.itertuples():
            piece = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert zlib.crc32(piece) == p.ids_crc32
    for _, w in out.sort_values("offset").groupby("sequence_id"):
        assert w.offset.tolist() == [0, *w.length.cumsum().tolist()[:-1]]
        assert w.length.sum() <= 2048
    assert packing.pack(docs.filter(F.lit(False))).count() == 0
