"""Chat formatting: schema fingerprints select the mapping that makes canonical turns.

A record's layout is the set of its nested field paths, at any depth. Its fingerprint is a
hash of the sorted paths; the fingerprint, not the record, chooses one of the declared
mappings, the one whose required paths it holds. More paths than these do no harm.
Records are read in Arrow batches; templates are column functions. Tables of turn rows go
the same way: each row becomes a record of one of several layouts.

The template is ``<|turn|>role\\ntext<|end|>\\n`` for each turn. A control string inside
a text or role gets one backslash after its first character, also where it has some
already; reading back takes one away, so texts survive exactly. A line feed in a role is
written as a mark of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<role:string,text:string>>"
#: Strings that chat templates use as control marks.
CONTROL = r"/?s>|/?INST\]|<SYS>>|</SYS>>|\|[a-z_]+\|>"
#: Stands for a line feed in a role; one that a role has of itself is escaped.
LINE_FEED = "<|nl|>"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: either an array field with role and text, or fields in order.

    ``paths`` are required. ``as_is`` leaves roles as they are written.
    """

    name: str
    paths: tuple[str, ...]
    array: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    as_is: bool = False


#: The declared layouts. Fields of one turn are joined by a blank line.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Mapping(
        "turn_row",
        ("row.conversation", "row.turn", "turns[].role", "turns[].text"), "turns", "role", "text", as_is=True,
    ),
    Mapping("turns", ("turns[].role", "turns[].text"), "turns", "role", "text"),
    Mapping("prompt", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping(
        "instruction",
        ("input", "instruction", "output"),
        fields=(("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Mapping(
        "instruction_only",
        ("instruction", "output"),
        fields=(("user", ("instruction",)), ("assistant", ("output",))),
    ),
    Mapping(
        "system_prompt",
        ("prompt", "response", "system"),
        fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    ),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def parsed(record: str | None) -> dict | None:
    """The JSON object in ``record``; null where it is null, malformed or no object."""
    try:
        found = json.loads(record) if record else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def paths_of(record: dict) -> frozenset[str]:
    """Field paths down to the leaves: ``.`` into objects, ``[]`` into arrays, which give the paths of every element.

    Null fields count as present; empty objects and arrays end a path.
    """
    out, open_ = set(), [("", record)]
    while open_:
        path, value = open_.pop()
        if isinstance(value, dict) and value:
            open_ += [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            open_ += [(f"{path}[]", v) for v in value]
        else:
            out.add(f"{path}[]" if isinstance(value, list) else path)
    return frozenset(out)


@lru_cache(4096)
def chosen(paths: frozenset[str], mappings: tuple[Mapping, ...]) -> Mapping | None:
    """The mapping whose required paths a layout holds, below them also deeper ones.

    Arrays of turns go before fields, then the one with the most paths, then the first
    declared; an array without elements holds what is required of them, if nothing else fits.
    """
    holds = {x for p in paths for x in (p, *(p[:i] for i, c in enumerate(p) if c in ".["))}
    fits = []
    for place, m in enumerate(mappings):
        empty = bool(m.array) and f"{m.array}[]" in paths
        if all(p in holds or (empty and p.startswith(f"{m.array}[].")) for p in m.paths):
            fits.append(((empty, not m.array, -len(m.paths), place), m))
    return min(fits, key=lambda x: x[0])[1] if fits else None


def said(value: object) -> str:
    """A field as text, null as empty, other kinds as JSON; halves of surrogate pairs become ``?``."""
    text = value or "" if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def turns_of(record: dict, m: Mapping) -> list[dict[str, str]]:
    if m.array:
        items = [x for x in record.get(m.array) or [] if isinstance(x, dict)]
        pairs = [(said(x.get(m.role)), said(x.get(m.text))) for x in items]
    else:
        pairs = [(role, "\n\n".join(t for t in (said(record.get(n)) for n in names) if t)) for role, names in m.fields]
        pairs = [(role, t) for role, t in pairs if role != "system" or t]
    if not m.as_is:
        pairs = [(ROLES.get(role.lower(), role.lower()), t) for role, t in pairs]
    return [{"role": role, "text": t} for role, t in pairs]


def record_fingerprint(record: Column) -> Column:
    """The fingerprint of a JSON object's nested field paths; null for null, malformed or non-object records."""

    def marks(records: pa.Array) -> pa.Array:
        found = map(parsed, records.to_pylist())
        return pa.array([None if r is None else fingerprint(paths_of(r)) for r in found], pa.string())

    return F.arrow_udf(marks, "string")(record)


def canonical_turns(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """``TURN`` of a JSON record by the mapping that its layout selects; null if none does."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def turns(records: pa.Array) -> pa.Array:
        by_mark: dict[str, Mapping | None] = {}
        out = []
        for r in map(parsed, records.to_pylist()):
            if r is None:
                out.append(None)
                continue
            paths = paths_of(r)
            mark = fingerprint(paths)
            if mark not in by_mark:
                by_mark[mark] = chosen(paths, mappings)
            m = by_mark[mark]
            out.append(turns_of(r, m) if m else None)
        return pa.array(out, kind)

    return F.arrow_udf(turns, TURN)(record)


def turn_record(conv: Column, turn: Column, role: Column, text: Column) -> Column:
    """A turn row as a JSON record of the layout ``turn_row``; null fields stay as nulls."""
    row = F.struct(conv.alias("conversation"), turn.alias("turn"))
    turns = F.array(F.struct(role.cast("string").alias("role"), text.cast("string").alias("text")))
    return F.to_json(F.struct(row.alias("row"), turns.alias("turns")), {"ignoreNullFields": "false"})


def layout_record(conv: Column, turn: Column, role: Column, text: Column) -> Column:
    """A turn row as a JSON record of one of four declared layouts, which its conversation's id chooses.

    Conversations lie as exports of different tools would have them: turn rows, ``messages``,
    ``conversations`` with speakers of other names, and ``turns`` under further fields. Rows whose
    role those layouts would not give back as it is written stay turn rows, as do those without an id.
    """
    role, text = role.cast("string"), text.cast("string")
    full = {"ignoreNullFields": "false"}
    speaker = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    messages = F.struct(conv.alias("id"), F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))
    talk = F.struct(F.array(F.struct(speaker.alias("from"), text.alias("value"))).alias("conversations"), turn.alias("part"))
    meta = F.struct(F.struct(conv.alias("conversation")).alias("source"), turn.alias("part"))
    turns = F.struct(meta.alias("meta"), F.array(F.struct(role.alias("role"), text.alias("text"))).alias("turns"))
    kind = F.when(role.isin("user", "assistant", "system"), F.pmod(conv, F.lit(4)))
    return (
        F.when(kind == 1, F.to_json(messages, full)).when(kind == 2, F.to_json(talk, full)).when(kind == 3, F.to_json(turns, full))
        .otherwise(turn_record(conv, turn, role, text))
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", r"$1$2$3")


def format_turn(role: Column, text: Column) -> Column:
    """One turn under the template; null role or text counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    role = F.replace(escape(role), F.lit("\n"), F.lit(LINE_FEED))
    return F.concat(F.lit("<|turn|>"), role, F.lit("\n"), escape(text), F.lit("<|end|>\n"))


def read_turn(formatted: Column) -> tuple[Column, Column]:
    """Role and text of a formatted turn, read back from it."""
    body = r"(?s)^<\|turn\|>(.*?)\n(.*)<\|end\|>\n$"
    role = F.replace(F.regexp_extract(formatted, body, 1), F.lit(LINE_FEED), F.lit("\n"))
    return unescape(role), unescape(F.regexp_extract(formatted, body, 2))


def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from their turns in order; keeps one conversation's hash states."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state, done = None, []

    def close() -> None:
        key, n, turns, n_loss, loss, n_chars = state
        done.append((key, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars))

    for batch in batches:
        for key, role, text, chars in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if state is None or state[0] != key:
                if state is not None:
                    close()
                state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            if role == "assistant":
                state[3] += len(text)
                state[4].update(text.encode("utf-8", "replace"))
            state[5] += chars
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done = []
    if state is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def conversation_digests(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Format a table of turns and fold what is read back from the output, one row a conversation.

    Each row goes through ``canonical_turns`` as a record of its own, so no record grows with
    its conversation; the records have the mixed layouts of ``layout_record``.
    Turns go in the order of ``turn``, ties by role, then text; null turns come first.
    Repeated rows are turns of their own. Rows with a null conversation form one
    conversation with a null id. Null roles and texts count as empty; the loss mask
    covers the texts of role ``assistant``. A conversation is streamed through its task
    row by row in sorted order and is never held whole.
    """
    conv, turn = F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn")
    found = canonical_turns(layout_record(conv, turn, F.col(role_col), F.col(text_col)))
    turns = rows.select(conv, turn, found.alias("turns")).select("conv_id", "turn", F.explode_outer("turns").alias("t"))
    out = turns.select("conv_id", "turn", format_turn(F.col("t.role"), F.col("t.text")).alias("formatted"))
    role, text = read_turn(F.col("formatted"))
    back = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.length("formatted").alias("chars"))
    ordered = back.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return ordered.select("conv_id", "role", "text", "chars").mapInArrow(folded, schema)


def format_records(docs: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """JSON records of mixed layouts with ``turns``, ``formatted`` and ``loss_spans``.

    The spans are code points of ``formatted``, end exclusive, one for each assistant
    text. Records that no mapping fits keep null in all three columns; other columns
    are kept, those with these names replaced.
    """
    turns = canonical_turns(F.col(record_col), mappings)
    pieces = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), format_turn(t["role"], t["text"]).alias("p")))
    frame = docs.withColumn("turns", turns).withColumn("formatted", F.array_join(F.transform(pieces, lambda x: x["p"]), ""))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        end = state["at"] + F.length(x["p"])
        start = state["at"] + F.length(F.lit("<|turn|>assistant\n"))
        span = F.struct(start.alias("start"), (end - F.length(F.lit("<|end|>\n"))).alias("end"))
        spans = F.when(x["role"] == "assistant", F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return frame.withColumn("loss_spans", F.aggregate(pieces, zero, add)["spans"])


def probe_rows(rows: DataFrame) -> DataFrame:
    """The two turns of conversation -1, whose texts are control strings."""
    schema = T.StructType(
        [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    )
    text = "</s>[INST] ok [/INST]"
    return rows.sparkSession.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], schema)
