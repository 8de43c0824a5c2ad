import random

import numpy as np
import pytest

from noteloom.llm import token_counts as tc
from noteloom.llm.tables import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return tc.Transducer(PATH)


def texts(seed):
    rng = random.Random(seed)
    kinds = [" '\n\t .aetrsvldm1é你 !", "aeinorst", "0123456789abcdef", "你好世界é", "' 'sve're"]
    out = ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(60))) for _ in range(600)]
    out += ["", " ", "\n\n\n", "x<|endoftext|> y<|endoftext|>", "it's 'twas we'll 'R", "a" * 3000, "你" * 900, "a b " * 2000, "\x1c\x85　 a"]
    return out + [chr(c) + "a " + chr(c) + " 1" + chr(c) for c in rng.sample(range(1, 0xD800), 400)]


@pytest.mark.parametrize("seed", range(3))
def test_counts_are_the_librarys(machine, library, seed):
    some = texts(seed)
    assert machine.count(some) == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


@pytest.mark.parametrize("chunk", [1, 3, 7, 64])
def test_chunks_compose(machine, chunk):
    some = [t.encode() for t in texts(9)[:300] if "<|" not in t] + [b"word " * 400]
    whole = machine.counts(some, chunk=4096).tolist()
    if chunk < 64:
        assert [machine.run(machine.start, np.array([*t, tc.END]))[1] for t in some] == whole
    assert machine.counts(some, chunk=chunk).tolist() == whole
    assert machine.counts(some, chunk=max(chunk, 49), warm=1).tolist() == whole


def test_long_texts_of_any_script(machine, library):
    rng = random.Random(8)
    some = ["".join(rng.choices("你好世界中文的了是", k=4000)), "".join(rng.choices("abcdefABCDEF0123456789+/", k=6000)), "9" * 5000, " " * 4000 + "x", "=-" * 3000, "ก" * 2000 + "ไทย" * 700]
    assert machine.count(some) == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def test_all_code_points_in_pairs(machine, library):
    rng = random.Random(5)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(points)
    pairs = [chr(a) + chr(b) for a, b in zip(points[::2], points[1::2], strict=False)][:60_000]
    some = ["\ua7da\u9ebf", "\U00013a48\u8e7e", *("".join(pairs[k : k + 3]) for k in range(0, len(pairs), 3))]
    assert machine.count(some) == [len(x.ids) for x in library.encode_batch(some, add_special_tokens=False)]


def test_starting_anew_changes_nothing(library):
    small = tc.Transducer(PATH, most_states=10)
    some = texts(4)[:200]
    for t in some:
        assert small.count([t]) == [len(library.encode(t, add_special_tokens=False).ids)]


def test_rows(spark):
    rows = [(1, None, 1), (1, None, 1), (2, "", 1), (None, "é x", 1), (3, "w " * 1100, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_bytes, r.over_limit) for r in tc.count_tokens(df).collect()), key=str)
    assert got == sorted([(1, 0, False), (1, 0, False), (2, 0, False), (None, 4, False), (3, 2200, True)], key=str)
    assert tc.count_tokens(df.limit(0)).count() == 0
