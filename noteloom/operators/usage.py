"""Accounting for model calls: windows of use, averages that forget, limits that recover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minute_use(calls: DataFrame, limit: int) -> DataFrame:
    """Tokens of each calendar minute by role, and whether they pass the limit."""
    w = calls.groupBy("role", F.date_trunc("minute", "ts").alias("minute")).agg(F.sum("tokens").alias("used"), F.count("*").alias("n_calls"))
    return w.withColumn("over", F.col("used") > limit)


def admitted(calls: DataFrame, limit: int) -> DataFrame:
    """Each call with the tokens of its minute before it; a call fits, or is alone in an empty minute."""
    w = Window.partitionBy("role", F.date_trunc("minute", "ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("tokens").over(w), F.lit(0))
    return calls.withColumn("before", before).withColumn("fits", (before + F.col("tokens") <= limit) | (before == 0))


def calls_in_last(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """How many calls of the role, itself included, are at most ``seconds`` old.

    Each slot of ``seconds`` of a role is counted on its own, with the calls of the slot
    before it, so no task holds all of a role. Calls without a time count among themselves.
    """
    at, span = F.unix_micros("ts"), seconds * 1_000_000
    slot = F.floor(at / span)
    own, next_ = F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))
    dealt = calls.withColumn("dealt", F.explode(F.when(slot.isNull(), F.array(own)).otherwise(F.array(own, next_))))
    w = Window.partitionBy("role", "dealt.slot").orderBy(at).rangeBetween(-span, 0)
    return dealt.withColumn("recent", F.count("*").over(w)).where("dealt.own").drop("dealt")


def hit_rate(calls: DataFrame, hit: Column) -> DataFrame:
    return calls.groupBy("role").agg(F.count_if(hit).alias("hits"), F.count("*").alias("n_calls")).withColumn("rate", F.col("hits") / F.col("n_calls"))


def moving_average(calls: DataFrame, value: Column, alpha: float = 0.3) -> DataFrame:
    """The exponential average of ``value`` over each role's calls in order, the first one as it is.

    A call's weight is alpha (1-alpha)^age, so the fold is a sum over ages and needs no
    ordered pass in one task; weights too small to matter are still summed.
    """
    asc = Window.partitionBy("role", "day").orderBy("ts", "event_id")
    days = calls.withColumn("day", F.to_date("ts")).withColumn("x", value)
    placed = days.withColumn("i", F.row_number().over(asc)).withColumn("n", F.count("*").over(Window.partitionBy("role", "day")))
    weight = F.pow(F.lit(1 - alpha), F.col("n") - F.col("i"))
    parts = placed.groupBy("role", "day").agg(
        F.sum(F.col("x") * weight * alpha).alias("s"), F.max("n").alias("n"), F.max(F.when(F.col("i") == 1, F.col("x"))).alias("first")
    )
    order = Window.partitionBy("role").orderBy("day")
    rest = F.coalesce(F.sum("n").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    sums = parts.withColumn("after", rest).withColumn("k", F.row_number().over(order))
    keep = F.lit(1 - alpha)
    total = F.sum(F.col("s") * F.pow(keep, F.col("after")))
    first = F.sum(F.when(F.col("k") == 1, F.col("first") * (1 - alpha) * F.pow(keep, F.col("n") + F.col("after") - 1)).otherwise(0.0))
    return sums.groupBy("role").agg((total + first).alias("average"))


def limit_after_hits(hits: Column, seconds: Column, base: int, factor: float = 0.8, floor: float = 0.5, recovery: float = 300.0) -> Column:
    """The limit some seconds after the last of ``hits`` refusals: cut by a factor, then rising in a line."""
    start = F.greatest(F.pow(F.lit(factor), hits), F.lit(floor))
    margin = start + (1 - start) * F.least(seconds / recovery, F.lit(1.0))
    return F.greatest(F.floor(margin * base), F.lit(1)).cast("long")


def running_calls(calls: DataFrame, most: int) -> DataFrame:
    """The number of a call within its role's day, and whether it stays within ``most``."""
    w = Window.partitionBy("role", F.to_date("ts")).orderBy("ts", "event_id")
    return calls.withColumn("number", F.row_number().over(w)).withColumn("allowed", F.col("number") <= most)
