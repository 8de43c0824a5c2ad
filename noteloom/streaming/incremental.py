"""A stream of note files or call logs into tables (breadth: the model has batches only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteloom.operators.vault import latest


def upsert_stream(stream: DataFrame, sink: str, checkpoint: str, key: str = "path", order: str = "updated_at") -> StreamingQuery:
    """Append each micro-batch's last rows under its number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, [key], order).write.mode("overwrite").parquet(f"{sink}/batch={number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(table: DataFrame, key: str = "path", order: str = "updated_at") -> DataFrame:
    return latest(table, [key], order)


def minute_use(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tokens by role and minute of a stream of calls; rows later than ``late`` are left out."""
    w = F.window("ts", "1 minute")
    use = stream.withWatermark("ts", late).groupBy("role", w).agg(F.sum("tokens").alias("used"), F.count("*").alias("n_calls"))
    return use.select("role", F.col("window.start").alias("minute"), "used", "n_calls")
