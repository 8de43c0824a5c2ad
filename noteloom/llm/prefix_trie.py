"""A trie over the turns of conversations, built from bursting containers.

A turn is a mark of ``MARK`` bytes: a digest of role and text and the text's length. A
conversation's marks are cut into pieces of ``level`` turns, so that no row grows with its
conversation; equal pieces under an equal prefix become one row with a count before anything
else is done. Each prefix at which pieces begin heads a container of the pieces (suffixes)
below it. A container of more than ``limit`` turns bursts: its head runs on along what all its
suffixes share, and the suffixes are dealt into new containers by their next turn. What is
left is dealt over the shards, sorted and swept into nodes; sums then go up through the burst
heads, and through the levels from the deepest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.tables import batches_of, giving_back
from noteloom.session import cut

MARK, LEVEL, LIMIT, ROUNDS = 20, 4096, 1 << 14, 24
#: So many oversized containers, of some 100 bytes each, are sent to all tasks; more are joined by a shuffle.
FEW = 10_000
NONE = hashlib.sha256().hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODES = [c.split()[0] for c in NODE.split(", ")]
#: Nodes, and with ``cid`` set the sums of a container, whose ``parent`` is the container that burst into it.
SWEPT = f"cid binary, parent binary, {NODE}"
ROOT = "X''"


def mark(role: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0")))


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marked turns ``(conv_id, part, place, mark)`` in order of ``place``, and ``(conv_id, part, first, n, before)``.

    A conversation's rows are dealt by ranges, so one that holds a third of all rows is sorted
    by many tasks: ``before`` counts its rows in the parts before.
    """
    empty = F.lit("")
    src = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    near = F.when(F.length("role") < 32, F.left("text", F.lit(32))).otherwise(empty)
    dealt = src.repartitionByRange("conv_id", "turn", F.left("role", F.lit(32)), near).sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = cut(dealt.select("conv_id", F.monotonically_increasing_id().alias("place"), mark(F.col("role"), F.col("text")).alias("mark")))
    turns = turns.withColumn("part", F.shiftright("place", 33))
    parts = turns.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def rebuilt(rows: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """``turns (conv_id, depth, mark)`` and ``convs (conv_id)``, each with the first turns of its group's conversation.

    Conversation c begins with the first h = crc32(c) % ``most`` turns of c - c % ``every``
    and goes on with its own after the first h.
    """
    turns, parts = numbered(rows)
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", h.alias("h"), base.alias("base"), "n")
    bases = sizes.where("conv_id = base").select("base", F.col("n").alias("there"))
    info = cut(sizes.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")))
    placed = turns.join(parts.join(info, "conv_id"), ["conv_id", "part"]).withColumn("k", F.expr("place - first + before + 1"))
    own = placed.where("k > h").select("conv_id", F.expr("k - h + taken").alias("depth"), "mark")
    lent = turns.where(F.col("conv_id") == base).join(parts, ["conv_id", "part"]).select(
        F.col("conv_id").alias("base"), F.expr("place - first + before + 1").alias("depth"), "mark"
    )
    begun = info.where("taken > 0").join(lent.where(F.col("depth") < most), "base").where("depth <= taken").select("conv_id", "depth", "mark")
    return own.unionByName(begun), info.select("conv_id")


def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the prefixes at which each conversation's pieces begin and end; pieces come in order."""
    schema, held, out = "conv_id long, level long, head binary, tail binary, ends boolean", None, []
    for batch in batches:
        for conv, level, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            same = held is not None and held[0] == conv
            if held:
                out.append((*held, not same))
            head = held[3] if same else b""
            held = (conv, level, head, hashlib.md5(head + digest).digest())
        if out:
            yield batches_of(schema, *zip(*out, strict=True))
            out = []
    if held:
        yield batches_of(schema, *[[x] for x in (*held, True)])


def sequences(turns: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pieces ``(level, head, suffix, tail, ends, n, conv)``, and the members ``(tail, conv_id)`` that end."""
    depth = F.col("depth") - 1
    grouped = turns.groupBy("conv_id", F.floor(depth / level).alias("level")).agg(F.array_sort(F.collect_list(F.struct("depth", "mark"))).alias("m"))
    pieces = cut(grouped.select("conv_id", "level", F.unhex(F.array_join(F.transform("m", lambda m: F.hex(m["mark"])), "")).alias("suffix")))
    narrow = pieces.select("conv_id", "level", F.unhex(F.md5("suffix")).alias("digest"))
    chain = cut(
        narrow.repartition("conv_id").sortWithinPartitions("conv_id", "level")
        .mapInArrow(chained, "conv_id long, level long, head binary, tail binary, ends boolean")
    )
    rows = pieces.join(chain, ["conv_id", "level"]).groupBy("level", "head", "suffix", "tail", "ends")
    return rows.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv")), chain.where("ends").select("tail", "conv_id")


def segments(batches: Iterable[pa.RecordBatch], most: int = 8192) -> Iterator[pa.RecordBatch]:
    """Runs of ids in order, as decimal lists, at most ``most`` ids a row."""
    held, ids = None, []
    for batch in batches:
        out = []
        for tail, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if tail != held or len(ids) >= most:
                if ids:
                    out.append((held, ids[0], ",".join(map(str, ids))))
                held, ids = tail, []
            ids.append(conv)
        if out:
            yield batches_of("tail binary, first long, ids string", *zip(*out, strict=True))
    if ids:
        yield batches_of("tail binary, first long, ids string", [held], [ids[0]], [",".join(map(str, ids))])


def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's list of ids from its runs in order."""
    schema, held, digest, out = "tail binary, ends_sha256 string", None, None, []
    for batch in batches:
        for tail, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if tail == held:
                digest.update(b"," + ids.encode())
                continue
            if digest:
                out.append((held, digest.hexdigest()))
            held, digest = tail, hashlib.sha256(ids.encode())
        if out:
            yield batches_of(schema, *zip(*out, strict=True))
            out = []
    if digest:
        yield batches_of(schema, [held], [digest.hexdigest()])


def end_lists(members: DataFrame) -> DataFrame:
    """``tail, ends_sha256``: a group of any size is put in order and written out by ranges, then digested run by run."""
    runs = members.repartitionByRange("tail", "conv_id").sortWithinPartitions("tail", "conv_id").mapInArrow(segments, "tail binary, first long, ids string")
    return runs.repartition("tail").sortWithinPartitions("tail", "first").drop("first").mapInArrow(listed, "tail binary, ends_sha256 string")


def swept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each container from its suffixes in order, and its sums. Keeps one container's nodes."""
    held, out, state = None, [], None

    def close() -> None:
        cid, parent, depth, head_conv = held
        above, length, n, conv, children, leaves, saved, ends = state
        total = [0, 0, 0]
        for i in range(len(above) - 1, -1, -1):  # what is below a node comes behind it
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * length[i]
            p = above[i]
            if p < 0:
                total = [total[0] + 1, total[1] + leaves[i], total[2] + saved[i]]
            else:
                n[p] += n[i]
                conv[p] = conv[i] if conv[p] is None else min(conv[p], conv[i])
                children[p] += 1
                leaves[p] += leaves[i]
                saved[p] += saved[i]
        level: list[int] = []
        for i, p in enumerate(above):
            level.append(depth + 1 if p < 0 else level[p] + 1)
            out.append((None, None, conv[i], level[i], head_conv if p < 0 else conv[p], n[i], children[i], leaves[i], saved[i], ends[i] or NONE))
        out.append((cid, parent, None, None, None, None, *total, None))

    for batch in batches:
        for cid, parent, depth, head_conv, rest, count, least, ends_sha, *below in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held is None or cid != held[0]:
                if held:
                    close()
                held, state, path, before = (cid, parent, depth, head_conv), tuple([] for _ in range(8)), [], b""
            above, length, n, conv, children, leaves, saved, ends = state
            same = shared(before, rest)
            del path[same:]
            for at in range(same * MARK, len(rest), MARK):
                for column, value in zip(state, (path[-1] if path else -1, int.from_bytes(rest[at + 16 : at + MARK], "big"), 0, None, 0, 0, 0, None), strict=True):
                    column.append(value)
                path.append(len(above) - 1)
            i, before = path[-1], rest
            n[i] += count
            conv[i] = least if conv[i] is None else min(conv[i], least)
            ends[i] = ends[i] or ends_sha
            children[i] += below[0]
            leaves[i] += below[1]
            saved[i] += below[2]
            if len(out) > 20_000:
                yield batches_of(SWEPT, *zip(*out, strict=True))
                out.clear()
    if held:
        close()
    if out:
        yield batches_of(SWEPT, *zip(*out, strict=True))


def shared(a: bytes, b: bytes) -> int:
    """How many first turns two suffixes share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // MARK
    low, high = 0, n // MARK  # the first ``low`` turns agree, the first ``high`` do not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * MARK] == b[: mid * MARK] else (low, mid)
    return low


def burst_paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes along the shared turns of each burst container, and its sums."""
    for batch in batches:
        out = []
        for cid, parent, depth, head_conv, path, n, conv, ends_sha, children, leaves, saved in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            turns = len(path) // MARK
            for k in range(turns, 0, -1):
                saved += (n - 1) * int.from_bytes(path[k * MARK - 4 : k * MARK], "big")
                last = k == turns
                out.append((None, None, conv, depth + k, conv if k > 1 else head_conv, n, children if last else 1, leaves, saved, (ends_sha if last else None) or NONE))
            out.append((cid, parent, None, None, None, None, 1 if turns else children, leaves, saved, None))
        if out:
            yield batches_of(SWEPT, *zip(*out, strict=True))


def shared_turns(lo: Column, hi: Column) -> Column:
    """How many first turns the least and the greatest suffix of a container share, so all of it."""

    def turns(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([shared(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())

    return F.arrow_udf(turns, "int")(lo, hi)


ROW = ["cid", "parent", "depth", "head_conv", "rest", "n", "conv", "ends_sha256", "children", "leaves", "saved"]


def level_nodes(rows: DataFrame, limit: int) -> DataFrame:
    """``SWEPT`` of the containers in ``rows (ROW)``: all their nodes, and sums with a null ``parent``."""
    bursts, done = [], []
    size = F.length("rest") / MARK
    for _ in range(ROUNDS):
        stats = rows.groupBy("cid").agg(
            F.sum(size).alias("turns"), F.sum("n").alias("members"), F.min("conv").alias("least"), F.min("rest").alias("lo"), F.max("rest").alias("hi")
        )
        large = stats.where(F.col("turns") > limit).where("lo <> hi")
        large = cut(large.select("cid", "members", "least", shared_turns(F.col("lo"), F.col("hi")).alias("same")))
        few = large.limit(FEW + 1).count()
        if not few:
            break
        known = rows.join(F.broadcast(large) if few <= FEW else large, "cid", "left")
        done.append(rows.join(F.broadcast(large) if few <= FEW else large, "cid", "left_anti"))
        moved = known.where("same is not null").withColumn("at", F.col("same") * MARK)
        kept = moved.where(F.length("rest") == F.col("at"))
        here = kept.groupBy("cid").agg(
            F.max("ends_sha256").alias("ends_sha256"), *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")]
        )
        head = moved.groupBy("cid").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("head_conv").alias("head_conv"),
            F.first(F.expr("substring(rest, 1, at)")).alias("path"), F.first("members").alias("n"), F.first("least").alias("conv"),
        )
        bursts.append(cut(head.join(here, "cid", "left")))
        turn = F.expr(f"substring(rest, at + 1, {MARK})")
        rows = cut(
            moved.where(F.length("rest") > F.col("at")).select(
                F.unhex(F.md5(F.concat("cid", turn))).alias("cid"),
                F.col("cid").alias("parent"),
                (F.col("depth") + F.col("same")).alias("depth"),
                F.when(F.col("same") > 0, F.col("least")).otherwise(F.col("head_conv")).alias("head_conv"),
                F.expr("substring(rest, at + 1)").alias("rest"),
                *ROW[5:],
            )
        )
    for more in done:
        rows = rows.unionByName(more)
    ordered = rows.select(ROW).repartition("cid").sortWithinPartitions("cid", "rest")
    out = cut(ordered.mapInArrow(lambda it: giving_back(swept, it), SWEPT))
    for burst in reversed(bursts):
        sums = out.where("cid is not null").groupBy(F.col("parent").alias("cid")).agg(
            *[F.sum(c).alias(f"{c}_below") for c in ("n_children", "n_leaves", "saved_tokens")]
        )
        pairs = (("children", "n_children_below"), ("leaves", "n_leaves_below"), ("saved", "saved_tokens_below"))
        added = [(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(a) for a, b in pairs]
        record = burst.join(sums, "cid", "left").select("cid", "parent", "depth", "head_conv", "path", "n", "conv", "ends_sha256", *added)
        out = out.unionByName(cut(record.mapInArrow(burst_paths, SWEPT)))
    return out


def nodes(turns: DataFrame, convs: DataFrame, level: int = LEVEL, limit: int = LIMIT) -> DataFrame:
    """``NODE``: one row for each distinct sequence of first turns of ``turns (conv_id, depth, mark)``, with the root.

    ``convs (conv_id)`` lists every conversation, also those without a turn; without any
    there is not even a root. Conversations alike in all turns end in one node. Marks stand
    for their turns: 128 bits of digest and 32 of length. A container bursts at most
    ``ROUNDS`` times; one still too large then is swept by one task all the same, which keeps
    its distinct nodes. The number of levels, which follow one another, is that of the longest
    conversation's turns by ``level``.
    """
    found, members = sequences(turns, level)
    empty = convs.join(members.select("conv_id"), "conv_id", "left_anti").select(F.expr(ROOT).alias("tail"), "conv_id")
    ends = cut(end_lists(members.unionByName(empty)))
    seqs = cut(found.join(ends.withColumn("ends", F.lit(True)), ["tail", "ends"], "left"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    first = seqs.groupBy(F.col("tail").alias("head")).agg(F.min("conv").alias("head_conv"))
    whole = root.select(F.expr(ROOT).alias("head"), F.col("conv_id").alias("head_conv"))
    deepest = seqs.agg(F.max("level")).first()[0]
    below, out = None, []
    for k in range(-1 if deepest is None else deepest, -1, -1):
        rows = seqs.where(F.col("level") == k).join(whole if k == 0 else first, "head")
        if below is None:
            rows = rows.select("*", *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")])
        else:
            sums = below.select(F.col("cid").alias("tail"), F.lit(False).alias("ends"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
            rows = rows.join(sums, ["tail", "ends"], "left").fillna(0, ["children", "leaves", "saved"])
        top = rows.select(
            F.col("head").alias("cid"), F.lit(None).cast("binary").alias("parent"), F.lit(k * level).cast("long").alias("depth"), "head_conv",
            F.col("suffix").alias("rest"), *ROW[5:],
        )
        made = level_nodes(top, limit)
        out.append(made.where("cid is null").select(NODES))
        below = made.where("cid is not null and parent is null").select("cid", "n_children", "n_leaves", "saved_tokens")
    top = root.where("n_convs > 0")
    own = ends.where(F.col("tail") == F.expr(ROOT)).select("ends_sha256")
    if below is None:
        below = convs.sparkSession.createDataFrame([], "cid binary, n_children long, n_leaves long, saved_tokens long")
    sums = below.where(F.col("cid") == F.expr(ROOT)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    one = F.lit(1)  # the root's three parts are of one row each
    row = top.withColumn("j", one).join(sums.withColumn("j", one), "j").join(own.agg(F.max("ends_sha256").alias("ends_sha256")).withColumn("j", one), "j")
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))
    result = row.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        leaves.cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
    )
    for part in out:
        result = result.unionByName(part)
    return result


def conversation_trie(rows: DataFrame, level: int = LEVEL, limit: int = LIMIT) -> DataFrame:
    """``nodes`` of the conversations of ``rows (conv_id, turn, role, text)`` as ``rebuilt`` puts them together.

    Turns go by ``turn``, null first, ties by role, then text; repeated rows are turns of
    their own; null roles and texts are empty. Rows with a null ``conv_id`` belong to no
    conversation. Other columns are not read. An empty table gives no rows.
    """
    turns, convs = rebuilt(rows.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string")))
    return nodes(turns, convs, level, limit)
