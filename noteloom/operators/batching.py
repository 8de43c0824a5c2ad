"""Batches of items under a token budget, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy(frames: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    """A new batch where the next item would exceed the budget; rows come sorted by list and order."""
    key, batch, used = object(), 0, 0
    for f in frames:
        numbers = []
        for k, n in zip(f["list_id"].tolist(), f["tokens"].tolist(), strict=True):
            if k != key:
                key, batch, used = k, 0, 0
            elif budget <= 0 or used + n > budget:
                batch, used = batch + 1, 0
            used += n
            numbers.append(batch)
        yield f.assign(batch=numbers)


def packed(items: DataFrame, budget: int) -> DataFrame:
    """``list_id, ord, tokens`` with ``batch``: items in order, each batch within ``budget`` if it can be."""
    rows = items.select(F.col("list_id").cast("long"), F.col("ord").cast("long"), F.col("tokens").cast("long"))
    ordered = rows.repartition("list_id").sortWithinPartitions("list_id", "ord")
    return ordered.mapInPandas(lambda it: greedy(it, budget), "list_id long, ord long, tokens long, batch long")


def capped(batches: DataFrame, most: int) -> DataFrame:
    """Batches cut again so that none has more than ``most`` items; ``part`` numbers the cuts."""
    place = F.row_number().over(Window.partitionBy("list_id", "batch").orderBy("ord"))
    return batches.withColumn("part", F.floor((place - 1) / most).cast("long"))
