"""Folders of text files as a Spark data source: every file a row, and rows written as files all at once by tasks.

Unlike Spark's own readers it keeps files whose names begin with ``_`` or ``.``, and skips only what lies in folders
whose names begin with ``.``. It opens any store that Arrow opens by its address; all executors must reach it.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from noteloom.session import ensure_checkpoint_dir, small_batches

STAGED = ".staged-"


def store(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the folder in it; a plain path is a local one."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    fs, path = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), posixpath.abspath(root))
    return fs, path.rstrip("/")


@dataclass
class Part(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    """Partitions of about ``bytes`` of files each; with ``inside``, of ``FOLDERS`` folders, in which tasks look for the file of that name."""

    FOLDERS = 256

    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", ".md")
        self.inside = options.get("inside")
        self.most = int(options.get("bytes", 32 << 20))

    def partitions(self) -> list[Part]:
        fs, root = store(self.root)
        if fs.get_file_info(root).type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no folder {self.root}")
        if self.inside is not None:
            own = (i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.Directory)
            names = sorted(n for n in own if not n.startswith("."))
            return [Part([f"{n}/{self.inside}" for n in names[k : k + self.FOLDERS]]) for k in range(0, len(names), self.FOLDERS)]
        out, held, size = [], [], 0
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            name = info.path[len(root) :].lstrip("/")
            if info.type != pafs.FileType.File or not name.endswith(self.suffix) or any(x.startswith(".") for x in name.split("/")[:-1]):
                continue
            if held and size + info.size > self.most:
                out.append(Part(held))
                held, size = [], 0
            held.append(name)
            size += info.size
        return [*out, Part(held)] if held else out

    def read(self, part: Part) -> Iterator[tuple]:
        if not part or not getattr(part, "names", None):
            return
        fs, root = store(self.root)
        for name in part.names:
            if self.inside is not None and fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
                continue
            with fs.open_input_stream(f"{root}/{name}") as file:
                yield name, file.read().decode("utf-8", "replace")


class TextFiles(DataSource):
    """Options: ``path``, ``suffix`` (.md) and ``bytes`` of a partition; ``inside`` reads only the file of that name in each folder under ``path``."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def read_files(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """``path, content`` of the files under ``root``, paths relative to it; bytes that aren't UTF-8 become U+FFFD."""
    spark.dataSource.register(TextFiles)
    return spark.read.format("text_files").option("suffix", suffix).load(root)


def read_inside(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``path, content`` of the files ``*/name`` under ``root``; only the folders are listed, what else they hold is not."""
    spark.dataSource.register(TextFiles)
    return spark.read.format("text_files").option("inside", name).load(root)


def staged(batches: Iterable[pa.RecordBatch], root: str, job: str) -> Iterator[pa.RecordBatch]:
    """Writes files to a folder of the task's own and says where: ``place, path``."""
    fs, root = store(root)
    task, n = uuid.uuid4().hex, 0
    for batch in batches:
        places, names = [], []
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            name = posixpath.normpath(path.as_py() or "")
            if name.startswith(("/", "..")) or name == ".":
                raise ValueError(f"not a path inside the folder: {path}")
            if not n:
                fs.create_dir(f"{root}/{job}/{task}")
            with fs.open_output_stream(f"{root}/{job}/{task}/{n}") as file:
                file.write((content.as_py() or "").encode())
            places.append(f"{task}/{n}")
            names.append(name)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(names, pa.string())], names=["place", "path"])


def existing(batches: Iterable[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Of ``path`` those that the folder has."""
    fs, root = store(root)
    for batch in batches:
        there = [n for n in batch.column(0).to_pylist() if fs.get_file_info(f"{root}/{n}").type != pafs.FileType.NotFound]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.string())], names=["path"])


def placed(batches: Iterable[pa.RecordBatch], root: str, job: str) -> Iterator[pa.RecordBatch]:
    """Moves ``place, path``; a task that runs again leaves what has been moved."""
    fs, root = store(root)
    made: set[str] = set()
    for batch in batches:
        for place, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            folder = posixpath.dirname(f"{root}/{name}")
            if folder not in made:
                fs.create_dir(folder)
                made.add(folder)
            try:
                fs.move(f"{root}/{job}/{place}", f"{root}/{name}")
            except FileNotFoundError:
                if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
                    raise
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])


def write_files(rows: DataFrame, root: str, overwrite: bool = False) -> None:
    """Rows ``path, content`` as files under ``root``: all of them, or none; none that exists is written over unless asked.

    Tasks stage the files, and move them when all are staged; the names stand in the shared checkpoint
    folder and don't come to the driver.
    """
    spark, job = rows.sparkSession, f"{STAGED}{uuid.uuid4().hex}"
    ensure_checkpoint_dir(spark)
    small_batches(spark)
    listing = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"
    try:
        rows.select("path", "content").mapInArrow(lambda it: staged(it, root, job), "place string, path string").write.parquet(listing)
        names = spark.read.parquet(listing)
        twice = sorted(r.path for r in names.groupBy("path").count().where("count > 1").limit(5).collect())
        there = [] if overwrite else [r.path for r in names.select("path").mapInArrow(lambda it: existing(it, root), "path string").limit(5).collect()]
        if twice or there:
            raise FileExistsError(f"written twice: {twice}; already there: {there}")
        names.repartition("path").mapInArrow(lambda it: placed(it, root, job), "n long").agg(F.sum("n")).collect()
    finally:
        fs, folder = store(root)
        if fs.get_file_info(f"{folder}/{job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/{job}")
        place = spark._jvm.org.apache.hadoop.fs.Path(listing)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
