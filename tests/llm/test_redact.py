import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from test_secret_scan import sample

from noteloom.llm import secret_scan as ss


def cut(text, spans):
    """Values out of a text, character by character."""
    inside, out, marked = [0] * len(text or ""), [], 0
    for a, b in sorted((s.end - len(s.value), s.end) for s in spans):
        marked = marked if inside[a] else marked + 1
        for i in range(a, b):
            inside[i] = inside[i] or marked
    last = 0
    for c, k in zip(text or "", inside, strict=True):
        if k and k != last:
            out.append("[SECRET]")
        if not k:
            out.append(c)
        last = k
    return "".join(out) if text is not None else None


def test_only_value_positions_go(spark):
    text = "token: international trade, internationally known; the international kind"
    df = spark.createDataFrame([(1, text), (2, "é𝄞 password=abcd1234 abcd1234x secret = 'abcd1234'."), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in ss.redact(df).collect()}
    assert got[1] == "token: [SECRET] trade, internationally known; the international kind"
    assert got[2] == "é𝄞 password=[SECRET] abcd1234x secret = '[SECRET]'." and got[3] is None


def test_against_brute_force(spark):
    rng = random.Random(8)
    texts = sample()
    texts += [" ".join(rng.sample(["token=" + "0a" * 20 + "Zz", "AKIA" + "1B" * 9, "f0" * 20, "é", "0a0a", "secret:" + "AKIA" + "7C" * 10], 4)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.secrets for r in ss.scan(df).collect()}
    got = {r.doc_id: r.text for r in ss.redact(df).collect()}
    assert got == {i: cut(t, spans[i]) for i, t in enumerate(texts)}
    assert sum(len(x) > 1 for x in spans.values()) > 20
