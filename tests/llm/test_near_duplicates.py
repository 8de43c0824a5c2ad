import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from test_jaccard_join import brute, exact

import corpus_pipeline as cp


def jaccard(a, b, width):
    a, b = exact(a, width), exact(b, width)
    return len(a & b) / len(a | b)


def planted():
    """Originals with a block cut or added at the end, and with scattered edits, at 0.8 to 0.9 of five words."""
    rng = random.Random(5)
    rows, pairs = [], []
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        copy = list(words)
        if k % 3 == 0:
            copy = copy[:340]
        elif k % 3 == 1:
            copy += [f"x{rng.randrange(5000)}" for _ in range(60)]
        else:
            for at in range(20, 400, 50):
                copy[at] = f"y{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        pairs.append((rows[-2], rows[-1]))
    far = rows[0][1].split()
    rows.append((100, " ".join(far[:300])))  # 0.75: stays
    return rows, pairs


def test_pipeline_removes_near_copies_of_five_words(spark):
    rows, pairs = planted()
    assert all(0.8 <= jaccard(a, b, 5) < 0.9 and jaccard(a, b, 3) < 0.9 for (_, a), (_, b) in pairs)
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(cp.STAGES)["ngram_jaccard"](spark, docs, "").collect()}
    assert kept == {i for i, _, c in brute(rows, 5, 80) if i == c}
    assert not kept & {b[0] for _, b in pairs}
