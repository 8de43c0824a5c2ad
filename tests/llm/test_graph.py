import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from test_jaccard_join import brute

from noteloom.llm import jaccard_join
from noteloom.llm.graph import components


def size_bits(df):
    """How long the number is by which Spark estimates the bytes of ``df``."""
    sys.set_int_max_str_digits(0)
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_sizes_do_not_grow_with_rounds(spark):
    """Far ends of a chain need many rounds, and what comes out can go into the next loop."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(500, 501), (502, 501)], "a long, b long")
    labels = components(edges)
    want = {k: 0 for k in range(301)} | {k: 500 for k in (500, 501, 502)}
    assert {r.node: r.label for r in labels.collect()} == want
    assert size_bits(labels) <= 64
    again = components(labels.selectExpr("node AS a", "label AS b"))
    assert {r.node: r.label for r in again.collect()} == want and size_bits(again) <= 64


def test_labels_of_structs(spark):
    edges = spark.createDataFrame([((1, 7), (1, 3)), ((2, 7), (2, 5)), ((1, 3), (1, 9))], "a struct<order:int,node:long>, b struct<order:int,node:long>")
    assert {(tuple(r.node), tuple(r.label)) for r in components(edges).collect()} == {((1, 3), (1, 3)), ((1, 7), (1, 3)), ((1, 9), (1, 3)), ((2, 5), (2, 5)), ((2, 7), (2, 5))}


def test_loops_in_a_row(spark):
    """Blocks above the bound go through three loops, each with what the one before it made."""
    rng, rows = random.Random(3), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)]
        for k in range(30):
            rows.append((family * 100 + k, " ".join(f"x{rng.randrange(50)}" if rng.random() < 0.07 else w for w in base)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=80, group_docs=7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 1, 80)
    assert size_bits(got) < 1000
