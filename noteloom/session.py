"""Session helpers: building a session and cutting lineage safely."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "noteloom", cpus: int | None = None) -> SparkSession:
    """A local session with the settings the library is tested under (UTC, AQE)."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; where it is unset only a local session (tests) gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Reliable checkpoint: its files outlive any executor, so a lost executor costs
    a reread and no recomputation of the lineage behind it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """``cut`` for what a loop joins with itself round after round: what goes on has no estimate of its size.

    A checkpoint keeps Spark's estimate of the plan behind it, and that of a join is the product of its sides'.
    So the number would get twice as long with each round, also from one loop to the next, until it filled the
    driver's memory. How the rows are dealt is forgotten too.
    """
    spark, rows = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the bytes of an Arrow batch as well as its rows, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, str(2**31 - 1), f"{2**31 - 1}b"):
        spark.conf.set(name, str(most))
