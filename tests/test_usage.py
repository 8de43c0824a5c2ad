import random
from datetime import datetime, timedelta

from noteloom.operators import usage


def test_sliding_counts_by_slots(spark):
    rng, start = random.Random(3), datetime(2026, 1, 1, 0, 0, 30)
    rows = [(k, rng.choice("ab"), start + timedelta(seconds=rng.choice([rng.randrange(400), 60 * rng.randrange(6)]))) for k in range(300)]
    rows += [(900, "a", None), (901, "a", None), (902, "c", start)]
    out = usage.calls_in_last(spark.createDataFrame(rows, "event_id long, role string, ts timestamp"))
    got = {r.event_id: r.recent for r in out.collect()}
    for k, role, ts in rows:
        same = [t for _, r, t in rows if r == role and (t is None) == (ts is None)]
        assert got[k] == sum(ts is None or timedelta(0) <= ts - t <= timedelta(seconds=60) for t in same)
    assert len(got) == len(rows) == out.count()
    keys = out._jdf.queryExecution().analyzed().toString().split("windowspecdefinition(")[1].split(" ASC")[0]
    assert len(keys.split(", ")) == 3  # role, slot, then the time of the order
