"""The token limit in force at every call of a stream: a state for each role, kept over restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "role string, event_id long, margin double, token_limit long"


def advance(calls: pd.DataFrame, state: tuple[float, float | None], base: int, factor: float, floor: float, recovery: float, mode: str) -> tuple[list[tuple], tuple[float, float | None]]:
    """Rows of one role's calls in order, and the state after them: the margin after the last refusal, and its time."""
    m, last = state
    out = []
    for event_id, at, hit in zip(calls["event_id"], calls["at"], calls["hit"], strict=True):
        gap = None if last is None else at - last
        share = 1.0 if gap is None or gap >= recovery else gap / recovery if mode == "linear" else 0.0
        now = m + (1 - m) * share
        out.append((int(event_id), now, max(int(now * base + 1e-6), 1)))
        if hit:
            m, last = max(now * factor, floor), at
    return out, (m, last)


def in_force(stream: DataFrame, base: int, factor: float = 0.8, floor: float = 0.5, recovery: float = 300.0, mode: str = "linear") -> DataFrame:
    """``OUT`` for a stream of ``role, ts, event_id, hit`` whose micro-batches follow each other in time.

    Within a micro-batch a role's calls go by time, then ``event_id``. A state whose last cut has been made
    good is dropped, so that roles that are no longer refused cost nothing.
    """
    rows = stream.where("ts is not null and role is not null").select("role", "event_id", (F.unix_micros("ts") / 1e6).alias("at"), F.coalesce("hit", F.lit(False)).alias("hit"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (1.0, None)
        calls = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out, after = advance(calls, before, base, factor, floor, recovery, mode)
        if after[1] is not None and calls["at"].iloc[-1] - after[1] < recovery:
            state.update((float(after[0]), float(after[1])))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["role", "event_id", "margin", "token_limit"])

    return rows.groupBy("role").applyInPandasWithState(step, OUT, "margin double, at double", "append", GroupStateTimeout.NoTimeout)
