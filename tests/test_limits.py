import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from noteloom.operators import limits
from noteloom.streaming import limits as stream_limits

SCHEMA = "role string, ts timestamp, event_id long, hit boolean"


def calls(seed, n=400):
    rng = random.Random(seed)
    at, out = pd.Timestamp("2024-01-01 20:00:00"), []
    for k in range(n):
        at += pd.Timedelta(seconds=rng.choice([0, 1, 30, 200, 299.5, 300, 301, 4000, 90_000] if k % 40 == 0 else [0, 1, 30, 100, 250]))
        out.append((rng.choice(["a", "b"]), at.to_pydatetime(), k, rng.random() < 0.2))
    return out


def brute(rows, mode, base=8000, factor=0.8, floor=0.5, recovery=300.0):
    state, out = {}, {}
    for role, ts, k, hit in sorted(rows, key=lambda r: (r[1], r[2])):
        m, last = state.get(role, (1.0, None))
        if last is not None:
            gap = (ts - last).total_seconds()
            m = m + (1 - m) * min(gap / recovery, 1) if mode == "linear" else 1.0 if gap >= recovery else m
        out[k] = (round(m, 9), max(int(base * m + 1e-6), 1))
        if hit:
            state[role] = (max(m * factor, floor), ts)
    return out


@pytest.mark.parametrize("mode", limits.MODES)
@pytest.mark.parametrize("seed", range(3))
def test_limits_are_those_of_an_ordered_pass(spark, mode, seed):
    rows = calls(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.event_id: (round(r.margin, 9), r.token_limit) for r in limits.in_force(df, 8000, mode=mode).collect()}
    assert got == brute(rows, mode)


def test_calls_without_time_and_unknown_modes(spark):
    df = spark.createDataFrame([("a", None, 1, True)], SCHEMA)
    assert limits.in_force(df, 10).count() == 0
    with pytest.raises(ValueError):
        limits.in_force(df, 10, mode="x")


@pytest.mark.parametrize("mode", limits.MODES)
def test_stream_goes_on_after_a_restart(spark, tmp_path, mode):
    rows = sorted(calls(7), key=lambda r: (r[1], r[2]))
    place, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in (rows[:150], rows[150:290], rows[290:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(SCHEMA).parquet(place)  # a new query each time, from the same checkpoint
        out = stream_limits.in_force(stream, 8000, mode=mode)
        out.writeStream.format("parquet").option("checkpointLocation", check).option("path", sink).trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: (round(r.margin, 9), r.token_limit) for r in spark.read.parquet(sink).collect()}
    assert got == brute(rows, mode)
    batch = limits.in_force(spark.createDataFrame(rows, SCHEMA), 8000, mode=mode)
    assert {r.event_id: r.token_limit for r in batch.select("event_id", F.col("token_limit")).collect()} == {k: v[1] for k, v in got.items()}
