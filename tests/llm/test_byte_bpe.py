import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from noteloom.llm import byte_bpe as bb
from noteloom.llm.tables import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed):
    rng = random.Random(seed)
    kinds = ["ab 'slr\n\t ve", "aeinorst ", "0123456789 a", "你好世界é。 ", "!?'s\n  ", "՘ab's ₝ ", "\xa0　 \nx"]
    out = ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(1, 900))) for _ in range(120)]
    out += ["a" * 700, "x " + "你" * 300 + " y", " " * 500 + "z", "'" * 300 + "ll we'll", "word " * 200, "<|endoftext|> " * 40, "", " "]
    return out + ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(200)) for _ in range(40)]


def want(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 16), (64, 32), (200, 50), (1 << 16, 1 << 10)])
def test_digests_are_the_librarys(spark, library, chunk, overlap):
    some = [*texts(chunk), None]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bb.digests(df, chunk=chunk, overlap=overlap).collect()}
    assert len(got) == len(some)
    for i, t in enumerate(some):
        assert got[i] == want(library, t), t


def test_rows_stay_as_they_are(spark, library):
    long = "many words, 你好 " * 6000
    rows = [(1, None, 1, "k"), (1, None, 1, "k"), (2, "", 2, "k"), (None, long, 3, "k"), (None, long, 3, "k"), (3, long, 3, None), (4, "x" * 300_000, 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, key string")
    out = bb.digests(df)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((r[0], *want(library, r[1]))) for r in rows)
    assert bb.digests(df.limit(0)).count() == 0


def test_bytes_that_are_not_text_count_as_the_replacement(spark, library):
    df = spark.sql("select 1L doc_id, cast(unhex('61ff62') as string) text")
    (row,) = bb.digests(df).collect()
    assert tuple(row)[1:] == want(library, "a�b")


def test_round_trip(spark):
    some = [*texts(5), None]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for r in bb.decode(bb.encode(df)).collect():
        assert (r.decoded is None and r.text is None) or bytes(r.decoded).decode() == r.text


def test_starts_hold_whatever_follows(library):
    bpe = bb.codec(PATH, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for t in texts(2):
        whole = set(bpe.starts(t, True))
        at = rng.randrange(len(t) + 1)
        assert set(bpe.starts(t[:at], False)) <= whole or bpe.unsettled(t)
