import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from noteloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r.decode(), t.decode()) for *_, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    if not full:
        return []
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(full[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def rows_of(seed, n=120):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        conv = rng.choice([c, c, 100 + c % 7, 300 + c, -c])
        for turn in range(rng.choice([1, 2, 3, 7, 9])):
            text = rng.choice(["a", "b", "longer é", "", None]) if turn > 1 else rng.choice(["a", "a", "a", "hello"])
            out.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "user", "assistant", None]), text, "x"))
    return out + [(None, 0, "user", "a", "x"), (700, 0, "u", "t", "x"), (700, 0, "u", "t", "x")]


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = pt.conversation_trie(df, **kw)
    assert out.columns == pt.NODES
    return sorted(str(tuple(r)) for r in out.collect())


@pytest.mark.parametrize(("level", "limit"), [(4096, 1 << 14), (3, 10), (2, 4), (1, 1)])
def test_nodes_are_the_brute_force_ones(spark, level, limit):
    rows = rows_of(level)
    assert found(spark, rows, level=level, limit=limit) == brute(rows)


def test_long_and_nested_conversations(spark):
    rows = [(c, t, "u", f"{t}", "x") for c in range(100, 118) for t in range(c - 98)]
    rows += [(c, t, "u", f"{t}", "x") for c in range(1200, 1204) for t in range(60)]
    assert found(spark, rows, level=8, limit=30) == brute(rows)


def test_empty_tables_and_lone_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "t", "x")]) == []
    for rows in ([(3, 1, "u", "t", "x")], [(1, None, None, None, None)]):  # 3 rebuilds to nothing or itself
        assert found(spark, rows) == brute(rows)


def test_many_ends_in_one_node(spark):
    members = spark.range(30_000).selectExpr("X'01' tail", "id conv_id").repartition(7)
    (row,) = pt.end_lists(members).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest()
