"""Reading the tables of a data folder and the tokenizer files."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from noteloom.session import small_batches  # noqa: F401  operators take it from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any store that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str, path: str | None = None) -> str:
    """``path`` where given, else the place of a public tokenizer's installed file."""
    if path is not None:
        return path
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Arrow kinds of the types that the schemas of this subpackage name.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def batches_of(schema: str, *columns) -> pa.RecordBatch:
    """A record batch of plain columns and arrays of them, with the names and types of ``schema``."""
    names, kinds = zip(*[part.split() for part in schema.split(", ")], strict=True)
    types = [pa.list_(ARROW[k[6:-1]]) if k.startswith("array") else ARROW[k] for k in kinds]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little to do
    puts off while disks fill. Call it where a checkpoint has made large shuffles useless.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def giving_back(run: Callable[..., Iterator[pa.RecordBatch]], batches: Iterable[pa.RecordBatch], *args) -> Iterator[pa.RecordBatch]:
    """``run(batches, *args)``, and then hand what it freed back to the system.

    Python workers are used again by later tasks and stages; without this each keeps the
    most that any of its tasks ever needed.
    """
    try:
        yield from run(batches, *args)
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to trim
            pass
