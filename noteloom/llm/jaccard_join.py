"""N-gram Jaccard join by filtering under several global token orders.

1. Documents with the same shingle set form a class; one class, one node.
2. The texts are put into packs where they are. Each pack sends the distinct shingles of its
   texts, as hashed numbers in buckets, and gets back how many texts hold each of those that
   others hold too, and which of its texts others stand for. So every shingle has its count
   over all documents, while only compact arrays are shuffled.
3. Two sets with the wanted similarity share a shingle of their prefixes under every order
   of all shingles. Each order goes from the rarest to the commonest and settles ties by a
   hash of its own. Prefixes without a shared shingle end a document's part; a passage that
   many documents share enters no prefix while rarer shingles fill it.
4. Under each order, nodes that share a prefix shingle are tied to the least one, not to each
   other. The components of the ties of one order are a filter; the filters of all orders
   are intersected: nodes that any order holds apart never meet. What is left are blocks.
5. Each block's texts meet once, in a task of bounded size. There a pair must pass the length
   filter and share prefix shingles under all orders, before its sets are compared; a pair
   that is already connected is not compared again. A block above the bound is dealt into
   parts that all meet a few of its nodes first; then only the rest, what did not join the
   largest group, meets all parts.
6. The components of the links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.graph import components
from noteloom.llm.shingles import mix, shingle_sets
from noteloom.llm.tables import batches_of, giving_back, let_go, small_batches
from noteloom.session import cut

ORDERS = (1, 2, 3)
#: Counts are told exactly up to this one; all commoner shingles count as equally common.
MOST = 255
#: About how many bytes of text make a pack, and how many shingles a bucket.
PACK_BYTES, BUCKET_SHINGLES = 3 << 20, 1 << 18
#: The bits of a shingle's mark within its bucket.
MARK_BITS = 24
#: The nodes of a large block that all its parts meet first.
HUBS = 16


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def shared_room(n: int, lone: int, percent: int) -> int:
    """How many shingles that others hold too are in a prefix, after the ``lone`` ones that no other holds."""
    return min(n - lone, prefix_length(n, percent) - lone)


def order_places(counts: np.ndarray, shingles: np.ndarray, order: int) -> np.ndarray:
    """The place of each shingle under one order: rarest first, ties by the order's own hash."""
    places = np.empty(len(shingles), np.int64)
    places[np.lexsort((mix(shingles, order), counts))] = np.arange(len(shingles))
    return places


def signed(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Size and two 64-bit sums of each document's set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sets = shingle_sets(part.column(1).to_pylist(), width)
            sums = [[int(mix(s, salt).sum(dtype=np.uint64).view(np.int64)) for s in sets] for salt in (11, 12)]
            yield batches_of("doc_id long, n long, sum_a long, sum_b long", part.column(0), [len(s) for s in sets], *sums)


PACK = "pack long, nodes array<long>, lengths array<int>, body binary"


def packed(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Texts in packs of about ``size`` bytes, compressed; a longer text is a pack of its own."""
    from pyspark import TaskContext

    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    made, held, nodes, parts, seen = 0, 0, [], [], set()

    def close() -> pa.RecordBatch:
        nonlocal made, held, nodes, parts, seen
        body = pa.compress(b"".join(parts), codec="zstd", asbytes=True)
        out = batches_of(PACK, [first + made], [nodes], [[len(p) for p in parts]], [body])
        made, held, nodes, parts, seen = made + 1, 0, [], [], set()
        return out

    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "replace")
            if (node, raw) in seen or not raw.split():
                continue
            if parts and held + len(raw) > size:
                yield close()
            nodes.append(node)
            parts.append(raw)
            seen.add((node, raw))
            held += len(raw)
    if parts:
        yield close()


def unpacked(lengths: list[int], body: bytes) -> list[bytes]:
    ends = np.cumsum([0, *lengths]).tolist()
    raw = pa.decompress(body, ends[-1], codec="zstd", asbytes=True) if ends[-1] else b""
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def marks(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of a hash: the bucket and a mark within it. Shingles of one mark count as one."""
    return mix(shingles, 0) >> np.uint64(64 - MARK_BITS - bits)


def squeezed(low: np.ndarray) -> bytes:
    """Rising marks of one bucket as steps, byte by byte of all steps, compressed."""
    steps = np.diff(low.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), codec="zstd", asbytes=True) if len(low) else b""


def loosened(raw: bytes, n: int) -> np.ndarray:
    """The marks that ``squeezed`` made of them, ``n`` of them."""
    steps = np.zeros((n, 4), np.uint8)
    if n:
        steps[:, :3] = np.frombuffer(pa.decompress(raw, 3 * n, codec="zstd", asbytes=True), np.uint8).reshape(3, n).T
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.uint32)


COUNTS = "bucket int, pack long, marks binary, counts binary"


def marked(batches: Iterable[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each pack by bucket, with how many of its texts hold them."""
    for batch in batches:
        for pack, lengths, body in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3)], strict=True):
            sets = shingle_sets(unpacked(lengths, body), width)
            values, counts = np.unique(marks(np.concatenate(sets), bits), return_counts=True)
            buckets = (values >> np.uint64(MARK_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
            low, few = values & np.uint64((1 << MARK_BITS) - 1), np.minimum(counts, MOST).astype(np.uint8)
            pieces = [(squeezed(x), y.tobytes()) for x, y in zip(np.split(low, cuts[1:]), np.split(few, cuts[1:]), strict=True)] if len(cuts) else []
            yield batches_of(COUNTS, buckets[cuts], [pack] * len(cuts), [x for x, _ in pieces], [y for _, y in pieces])


def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each pack those of its shingles that other texts hold too, with counts; rows come sorted by bucket."""

    def answer(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        all_marks = np.concatenate([loosened(m, len(c)) for _, m, c in rows])
        values, at = np.unique(all_marks, return_inverse=True)
        counts = np.bincount(at, np.concatenate([np.frombuffer(c, np.uint8) for _, _, c in rows])).astype(np.int64)
        many = np.minimum(counts, MOST).astype(np.uint8)[at]
        ends = np.cumsum([len(c) for _, _, c in rows])[:-1]
        out = [(squeezed(x[y > 1]), y[y > 1].tobytes()) for x, y in zip(np.split(all_marks, ends), np.split(many, ends), strict=True)]
        return batches_of(COUNTS, [bucket] * len(rows), [p for p, _, _ in rows], [x for x, _ in out], [y for _, y in out])

    key, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if bucket != key:
                if rows:
                    yield answer(key, rows)
                key, rows = bucket, []
            rows.append(row)
    if rows:
        yield answer(key, rows)


class Union:
    """Sets of numbers that grow together; the least of a set stands for it."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)


FOUND = "node long, sum long, n long, tied array<long>, text binary, bytes int, order int, tokens array<long>, nodes array<long>"
#: A text of a node; a node has more than one where rows share an id.
WHO = ["node", "sum"]


def suspects_of(nodes: np.ndarray, texts: list[bytes], width: int, percent: int, known: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """The nodes of a pack whose prefixes hold shared shingles, and these shingles with the nodes they tie.

    ``known`` are the sorted marks of shared shingles, ``counts`` their counts. Nodes that share a
    prefix shingle within the pack are tied here, and the least one is sent for all of them.
    """
    order_of = np.argsort(nodes, kind="stable")
    nodes, texts = nodes[order_of], [texts[i] for i in order_of]
    sets = shingle_sets(texts, width)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(known, marks(flat, bits)), max(0, len(known) - 1))
    many = np.where(known[at] == marks(flat, bits), counts[at], 1).astype(np.int64) if len(known) else np.ones(len(flat), np.int64)
    size = np.array([len(s) for s in sets])
    lone = np.bincount(owner[many == 1], minlength=len(sets))
    room = np.array([shared_room(int(n), int(u), percent) for n, u in zip(size, lone, strict=True)])
    some = (many > 1) & (room[owner] > 0)
    flat, owner, many = flat[some], owner[some], many[some]
    tied = np.repeat(nodes[:, None], len(ORDERS), axis=1)
    tokens: list[tuple[np.ndarray, np.ndarray, int]] = []
    for k, order in enumerate(ORDERS):
        place = np.lexsort((mix(flat, order), many, owner))
        starts = np.searchsorted(owner[place], np.arange(len(sets)))
        inside = place[np.arange(len(place)) - starts[owner[place]] < room[owner[place]]]
        inside = inside[np.argsort(flat[inside], kind="stable")]
        token, who = flat[inside], owner[inside]
        same = token[1:] == token[:-1]
        union = Union(len(sets))
        for x, y in np.unique(np.c_[who[:-1][same], who[1:][same]], axis=0).tolist():
            union.join(x, y)
        root = np.array([union.find(x) for x in range(len(sets))], np.int64)
        tied[:, k] = nodes[root]
        first = np.flatnonzero(np.r_[True, ~same]) if len(token) else np.empty(0, np.int64)
        times = np.diff(np.r_[first, len(token)])
        far = (many[inside][first] > times) | (many[inside][first] == MOST)  # other packs hold it too
        tokens.append((token[first][far], tied[who[first][far], k], order))
    out = np.flatnonzero(room > 0).tolist()
    sums = [int(mix(sets[i], 11).sum(dtype=np.uint64).view(np.int64)) for i in out]
    none, rest = [None] * len(out), [None] * len(tokens)
    return batches_of(
        FOUND,
        [*nodes[out].tolist(), *rest],
        [*sums, *rest],
        [*size[out].tolist(), *rest],
        [*tied[out], *rest],
        [*[pa.compress(texts[i], codec="zstd", asbytes=True) for i in out], *rest],
        [*[len(texts[i]) for i in out], *rest],
        [*none, *[order for _, _, order in tokens]],
        [*none, *[t.view(np.int64) for t, _, _ in tokens]],
        [*none, *[who for _, who, _ in tokens]],
    )


def filtered(batches: Iterable[pa.RecordBatch], width: int, percent: int, bits: int) -> Iterator[pa.RecordBatch]:
    """``suspects_of`` each pack; rows come sorted by pack, what was told to it before its texts.

    ``spare`` are ids whose sets other ids stand for, so their texts go.
    """
    key, told_to, gone = None, [], set()
    names = ("pack", "body", "spare", "bucket", "marks", "counts", "nodes", "lengths")
    for batch in batches:
        for pack, body, spare, bucket, low, counts, nodes, lengths in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if pack != key:
                key, told_to, gone = pack, [], set()
            if body is None:
                gone.update(spare or ())
                told_to += [(bucket, low, counts)] if bucket is not None else []
                continue
            told_to.sort(key=lambda x: x[0])
            known = [loosened(m, len(c)).astype(np.uint64) | np.uint64(b << MARK_BITS) for b, m, c in told_to]
            many = np.frombuffer(b"".join(c for _, _, c in told_to), np.uint8)
            known = np.concatenate([*known, np.empty(0, np.uint64)])
            left = [(node, text) for node, text in zip(nodes, unpacked(lengths, body), strict=True) if node not in gone]
            if left:
                yield suspects_of(np.array([node for node, _ in left], np.int64), [text for _, text in left], width, percent, known, many, bits)
            told_to = []


def linked(nodes: list[int], sets: list[np.ndarray], percent: int, sides: list[int] | None = None, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """``(node, least node)`` for every node of a task that is connected to a lesser one by links.

    Nodes of one side other than 0 aren't compared with each other; nodes of one group are
    connected already. The orders go by the counts within the task, which is an order of all
    its shingles like any other.
    """
    rank = sorted(range(len(nodes)), key=lambda i: (len(sets[i]), nodes[i]))
    sizes = np.array([len(sets[i]) for i in rank])
    side = np.array([sides[i] if sides else 0 for i in rank])
    values, ids, counts = np.unique(np.concatenate([*(sets[i] for i in rank), np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    ids = np.split(ids, np.cumsum(sizes)[:-1]) if len(rank) else []
    places = [order_places(counts, values, k) for k in ORDERS]
    prefixes: list[list[frozenset[int]]] = []
    for own in ids:
        shared = own[counts[own] > 1]
        room = shared_room(len(own), len(own) - len(shared), percent)
        if room > 0:
            some = [shared[np.argpartition(p[shared], room - 1)[:room]] for p in places]
            prefixes.append([frozenset(x.tolist()) for x in some])
        else:
            prefixes.append([])
    root = np.arange(len(rank))

    def join(x: int, y: int) -> None:
        old, new = max(root[x], root[y]), min(root[x], root[y])
        root[root == old] = new

    seen: dict[int, int] = {}
    for x, i in enumerate(rank if groups else []):
        if groups[i] is not None and seen.setdefault(groups[i], x) != x:
            join(x, seen[groups[i]])
    held = np.zeros(len(values), bool)
    for x in range(len(rank)):
        if not prefixes[x]:
            continue
        held[ids[x]] = True
        near = (sizes[:x] >= -(-percent * sizes[x] // 100)) & ((side[:x] != side[x]) | (side[x] == 0))
        open_ = np.flatnonzero(near & (root[:x] != root[x]))
        while len(open_):
            y = int(open_[-1])
            ours = bool(prefixes[y]) and all(not a.isdisjoint(b) for a, b in zip(prefixes[x], prefixes[y], strict=True))
            both = int(held[ids[y]].sum()) if ours else 0
            open_ = open_[:-1]
            if ours and 100 * both >= percent * (sizes[x] + sizes[y] - both):
                join(x, y)
                open_ = open_[root[open_] != root[x]]
        held[ids[x]] = False
    least: dict[int, int] = {}
    for x, i in enumerate(rank):
        least[root[x]] = min(least.get(root[x], nodes[i]), nodes[i])
    return [(nodes[i], least[root[x]]) for x, i in enumerate(rank) if least[root[x]] != nodes[i]]


def met(batches: Iterable[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links within each task; rows come sorted by task, and only one task is held at a time."""
    key, held, seen = None, [], set()

    def close() -> pa.RecordBatch:
        sets = shingle_sets([pa.decompress(t, n, codec="zstd", asbytes=True) if n else b"" for *_, t, n in held], width)
        found = linked([r[0] for r in held], sets, percent, [r[1] for r in held], [r[2] for r in held])
        return batches_of("a long, b long", [a for a, _ in found], [b for _, b in found])

    for batch in batches:
        for task, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if task != key:
                if len(held) > 1:
                    yield close()
                key, held, seen = task, [], set()
            if (row[0], row[3]) not in seen:  # rows that repeat
                seen.add((row[0], row[3]))
                held.append(row)
    if len(held) > 1:
        yield close()


def links_within(tasks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: links of ``tasks (task, node, sum, side, known)``, each with the texts of its nodes."""
    meet = tasks.join(texts.select(*WHO, "text", "bytes"), WHO).select(F.to_json("task").alias("task"), "node", "side", "known", "text", "bytes")
    keyed = meet.repartition("task").sortWithinPartitions("task")
    return keyed.mapInArrow(lambda it: giving_back(met, it, width, percent), "a long, b long").where("a <> b")


def large_block_links(blocks: DataFrame, texts: DataFrame, width: int, percent: int, docs: int, shingles: int) -> DataFrame:
    """Links of blocks above the bound: ``blocks`` has ``node, sum, block, n, parts``.

    All parts meet ``HUBS`` nodes of their block. What is connected with the largest group then is
    dealt into parts that only meet the rest; every two parts of the rest meet.
    """

    def task(kind: str, *numbers: Column) -> Column:
        return F.struct("block", F.lit(kind).alias("kind"), *[x.cast("long").alias(f"n{k}") for k, x in enumerate(numbers)]).alias("task")

    h = F.xxhash64("node")
    part = F.pmod(h, F.col("parts"))
    hubs = blocks.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(h, "node"))).where(F.col("place") <= HUBS)
    all_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    none = F.lit(None).cast("long").alias("known")
    first = blocks.join(hubs.select(*WHO), WHO, "left_anti").select(task("hubs", part), *WHO, F.lit(2).alias("side"), none)
    first = first.unionByName(hubs.select("block", *WHO, all_parts).select(task("hubs", F.col("part")), *WHO, F.lit(0).alias("side"), none))
    early = cut(links_within(first, texts, width, percent))
    groups = cut(blocks.join(components(early).withColumnRenamed("label", "found"), "node", "left").withColumn("known", F.coalesce("found", "node")).drop("found", "parts"))
    main = groups.groupBy("block", "known").count().groupBy("block").agg(F.max_by("known", F.struct("count", "known")).alias("main"))
    sided = groups.join(main, "block").withColumn("rest", F.col("known") != F.col("main"))
    room = F.greatest(F.ceil(F.count("*") / docs), F.ceil(F.sum("n") / shingles)).cast("long")
    sizes = sided.groupBy("block", "rest").agg(room.alias("parts"))
    rest_of = sizes.where("rest").select("block", F.col("parts").alias("r"))
    main_of = sizes.where("not rest").select("block", F.col("parts").alias("m"))
    dealt = sided.join(rest_of, "block").join(main_of, "block")
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("other")
    own = F.pmod(h, F.when(F.col("rest"), F.col("r")).otherwise(F.col("m")))
    spread = dealt.withColumn("own", own)
    among = spread.where("rest").select("*", other("r")).select(task("rest", F.least("own", "other"), F.greatest("own", "other")), *WHO, F.lit(0).alias("side"), "known")
    across = spread.where("rest").select("*", other("m")).select(task("across", F.col("own"), F.col("other")), *WHO, F.lit(1).alias("side"), "known")
    across = across.unionByName(
        spread.where("not rest").select("*", other("r")).select(task("across", F.col("other"), F.col("own")), *WHO, F.lit(2).alias("side"), "known")
    )
    late = links_within(among, texts, width, percent).unionByName(links_within(across, texts, width, percent))
    return early.unionByName(cut(late))


def block_links(found: DataFrame, width: int, percent: int, docs: int, shingles: int) -> DataFrame:
    """Links among the suspects in ``found`` (``FOUND``), after the filters of all orders are intersected."""
    texts = found.where("order is null").select(*WHO, "n", "tied", "text", "bytes")
    each = F.explode(F.arrays_zip(F.col("tokens").alias("token"), F.col("nodes").alias("node"))).alias("t")
    tokens = found.where("order is not null").select("order", each).select("order", "t.token", "t.node")
    hubs = tokens.groupBy("order", "token").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    ties = tokens.join(hubs.select("order", "token", "hub"), ["order", "token"]).where("node <> hub")
    labels = components(ties.select(F.struct("order", "node").alias("a"), F.struct("order", F.col("hub").alias("node")).alias("b")).distinct())
    at = F.explode(F.arrays_zip(F.array(*[F.lit(k) for k in ORDERS]).alias("order"), F.col("tied").alias("node")))
    flat = texts.select(F.struct(*WHO).alias("who"), "n", at.alias("node"))
    named = flat.join(labels, "node", "left").select("who", "n", "node.order", F.coalesce("label.node", "node.node").alias("label"))
    filters = [F.max(F.when(F.col("order") == k, F.col("label"))).alias(f"f{k}") for k in ORDERS]
    nodes = cut(named.groupBy("who").agg(F.max("n").alias("n"), *filters).select("who.*", "n", F.struct(*[f"f{k}" for k in ORDERS]).alias("block")))
    parts = F.greatest(F.ceil(F.count("*") / docs), F.ceil(F.sum("n") / shingles)).cast("long")
    sizes = nodes.groupBy("block").agg(F.count("*").alias("members"), parts.alias("parts")).where("members > 1")
    sized = nodes.join(sizes, "block").select("block", *WHO, "n", "parts")
    small = sized.where("parts = 1").select("block", *WHO, F.lit(0).alias("side"), F.lit(None).cast("long").alias("known"))
    links = links_within(small.withColumnRenamed("block", "task"), texts, width, percent)
    large = sized.where("parts > 1")
    if sizes.where("parts > 1").isEmpty():
        return links
    return links.unionByName(large_block_links(cut(large), texts, width, percent, docs, shingles))


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    percent: int = 90,
    group_docs: int = 1500,
    group_shingles: int = 1_000_000,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of
    ``width``-word shingles; the component is the least id reachable by links. Null and
    empty texts have an empty set, link with nothing and keep their own id. Equal sets
    always link. Repeated rows each come out; rows that share an id count as one
    document, so they have one component, whatever their texts. Rows with a null id link
    nothing and have a null component. Shingles are compared as 64-bit hashes, equal sets as
    128 bits of sums. Ties play no part and other columns are not read.

    ``group_docs`` and ``group_shingles`` bound what meets in one task; larger blocks meet
    in several, and no link is lost.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signs = cut(texts.mapInArrow(lambda it: giving_back(signed, it, width), "doc_id long, n long, sum_a long, sum_b long"))
    same = ["n", "sum_a", "sum_b"]
    classes = signs.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node"))
    members = cut(signs.join(classes, same, "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")))
    repeated = cut(members.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c"), F.min("node").alias("least")).where("c > 1").drop("c"))
    total = members.agg(F.sum("n")).first()[0] or 0
    bits = max(6, int(total // BUCKET_SHINGLES).bit_length())
    nodes = members.where("node is not null").select(F.col("node").alias("doc_id")).distinct()
    packs = cut(texts.where("doc_id is not null").mapInArrow(lambda it: giving_back(packed, it, PACK_BYTES), PACK))
    spare = packs.select("pack", F.explode("nodes").alias("doc_id")).join(nodes, "doc_id", "left_anti")
    spare = spare.groupBy("pack").agg(F.collect_list("doc_id").alias("spare"))  # no more than a pack holds
    counted = packs.mapInArrow(lambda it: giving_back(marked, it, width, bits), COUNTS)
    answers = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: giving_back(told, it), COUNTS)
    both = answers.unionByName(packs, allowMissingColumns=True).unionByName(spare, allowMissingColumns=True).repartition("pack").sortWithinPartitions("pack", F.col("body").isNotNull())
    found = cut(both.mapInArrow(lambda it: giving_back(filtered, it, width, percent, bits), FOUND))
    del packs, spare, counted, answers, both
    let_go(docs.sparkSession)
    links = block_links(found, width, percent, group_docs, group_shingles)
    twice = members.join(repeated, "doc_id").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = components(links.unionByName(twice))
    del found, links
    let_go(docs.sparkSession)
    placed = members.join(repeated, "doc_id", "left").select("doc_id", "n", F.coalesce("node", "least").alias("node"))
    named = placed.join(groups, "node", "left")
    own = F.coalesce("label", "node", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
