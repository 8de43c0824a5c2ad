"""The token limit in force at every call: cut at each refusal, recovered in a line or in one step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("linear", "step")


def recovered(gap: Column, recovery: float, mode: str) -> Column:
    """The share of a cut that is made good ``gap`` seconds after it; all of it where there was none (null)."""
    if mode not in MODES:
        raise ValueError(f"mode {mode}: one of {MODES} is wanted")
    whole = gap.isNull() | (gap >= recovery)
    return F.when(whole, 1.0).otherwise(gap / recovery if mode == "linear" else 0.0)


def folded(frames: Iterator[pd.DataFrame], factor: float, floor: float) -> Iterator[pd.DataFrame]:
    """The margin after each refusal; those of a role and day come in order, with the margin before the first one."""
    key, m = None, 1.0
    for f in frames:
        out = []
        for role, day, share, start in zip(f["role"], f["day"], f["share"], f["start"], strict=True):
            if (role, day) != key:
                key, m = (role, day), start
            m = max((m + (1 - m) * share) * factor, floor)
            out.append(m)
        yield f[["role", "day", "at", "event_id"]].assign(margin=out)


def margins(hits: DataFrame, factor: float, floor: float, recovery: float, mode: str) -> DataFrame:
    """``role, day, at, event_id, margin``: the margin right after each refusal.

    A refusal takes the margin m to max(a + b m, c). Such maps compose to one of their kind, so each day of
    a role is folded on its own, days are composed in order, and no task holds all of a role.
    """
    lists = hits.groupBy("role", "day").agg(F.array_sort(F.collect_list(F.struct("at", "event_id"))).alias("h"))
    by_day = Window.partitionBy("role").orderBy("day")
    lists = lists.withColumn("last", F.lag(F.element_at("h", -1)["at"]).over(by_day))
    gap = lambda x, i: x["at"] - F.when(i > 0, F.get("h", i - 1)["at"]).otherwise(F.col("last"))
    shares = lists.withColumn("h", F.transform("h", lambda x, i: F.struct(x["at"].alias("at"), x["event_id"].alias("event_id"), recovered(gap(x, i), recovery, mode).alias("share"))))
    same = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(-1e9).alias("c"))

    def then(s: Column, x: Column) -> Column:
        a, b = x["share"] * factor, (1 - x["share"]) * factor
        return F.struct((a + b * s["a"]).alias("a"), (b * s["b"]).alias("b"), F.greatest(a + b * s["c"], F.lit(floor)).alias("c"))

    composed = shares.withColumn("map", F.aggregate("h", same, then))
    before = F.collect_list("map").over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    started = composed.withColumn("start", F.aggregate(before, F.lit(1.0), lambda m, x: F.greatest(x["a"] + x["b"] * m, x["c"])))
    rows = started.select("role", "day", "start", F.explode("h").alias("x")).select("role", "day", "x.*", "start")
    ordered = rows.repartition("role", "day").sortWithinPartitions("role", "day", "at", "event_id")
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("role", "day", "at", "event_id")) + ", margin double"
    return ordered.mapInPandas(lambda it: folded(it, factor, floor), schema)


def in_force(calls: DataFrame, base: int, factor: float = 0.8, floor: float = 0.5, recovery: float = 300.0, mode: str = "linear") -> DataFrame:
    """``role, event_id, margin, token_limit``: what a call found of its role's limit, before it was itself refused or not.

    ``calls`` has ``role, ts, event_id, hit``; calls go by time, then ``event_id``. ``linear`` recovers evenly over
    ``recovery`` seconds after the last refusal, ``step`` all at once at their end. Calls without a time are left out.
    """
    rows = calls.where("ts is not null").select("role", "event_id", (F.unix_micros("ts") / 1e6).alias("at"), F.to_date("ts").alias("day"), F.coalesce("hit", F.lit(False)).alias("hit"))
    after = margins(rows.where("hit"), factor, floor, recovery, mode)
    known = rows.join(after.select("role", "day", "event_id", "margin"), ["role", "day", "event_id"], "left")
    seen = F.when(F.col("hit"), F.struct("at", "margin"))
    today = Window.partitionBy("role", "day").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    days = known.groupBy("role", "day").agg(F.max_by(seen, F.when(F.col("hit"), F.struct("at", "event_id"))).alias("of_day"))
    earlier = Window.partitionBy("role").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("carried", F.last("of_day", ignorenulls=True).over(earlier)).drop("of_day")
    found = known.withColumn("own", F.last(seen, ignorenulls=True).over(today)).join(days, ["role", "day"]).withColumn("s", F.coalesce("own", "carried"))
    share = recovered(F.col("at") - F.col("s.at"), recovery, mode)
    margin = F.coalesce(F.col("s.margin") + (1 - F.col("s.margin")) * share, F.lit(1.0))
    out = found.select("role", "event_id", margin.alias("margin"))
    return out.withColumn("token_limit", F.greatest(F.floor(F.col("margin") * base + 1e-6), F.lit(1)).cast("long"))
