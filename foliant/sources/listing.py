"""Files of a folder as a partitioned Spark source: folders are listed in tasks, contents are read in others."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..stages import hadoop_path, saved

LISTED = "path string, modificationTime timestamp, length bigint"
ENOUGH = 256  # folders that are looked into before the rest is dealt to tasks
DEALT = 16  # folders of a task at least
TASKS = 512  # tasks at most that list what lies at one depth
FEW = 1000  # files that go to one folder when texts are written
READ = 64 << 20  # bytes of contents that a task reads, about
SENT = 16 << 20  # bytes of contents that leave a task at once


def opened(path: str):
    """(file system, path in it, what stands before a path of it), of the stores that this library reads itself."""
    from pyarrow import fs

    if not re.match(r"[a-z][a-z0-9]*:", path):
        path = "file://" + path
    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub("^s3[an]:", "s3:", path)))
    return store, inner.rstrip("/"), "file:" if store.type_name == "local" else re.match(r"([a-z0-9]+:)(//[^/]*)?", path)[0]


def _known(path: str) -> bool:
    try:
        opened(path)
    except (OSError, ValueError, ImportError, NotImplementedError):
        return False
    return True


class Folders(InputPartition):
    """Folders with all below them, or (deep = False) their own files alone."""

    def __init__(self, paths: list[str], deep: bool):
        super().__init__((paths, deep))
        self.paths, self.deep = paths, deep


class Files(DataSource):
    """path, modificationTime and length of every file below a folder (option path), files without any byte included."""

    @classmethod
    def name(cls) -> str:
        return "foliant_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self.options["path"])


class FilesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """Goes down level by level only until there are enough folders to deal."""
        from pyarrow import fs

        store, top, _ = opened(self.path)
        if store.get_file_info(top).is_file:
            return [Folders([top], True)]
        seen, level = [], [top]
        while level and len(level) < ENOUGH:
            seen += level
            level = [x.path for folder in level for x in store.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory]
        dealt = max(DEALT, -(-max(len(seen), len(level)) // TASKS))
        return [Folders(x[i : i + dealt], deep) for x, deep in ((seen, False), (level, True)) for i in range(0, len(x), dealt)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _, before = opened(self.path)
        for path in partition.paths:
            info = store.get_file_info(path)
            found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=partition.deep))
            found = [x for x in found if x.is_file and not re.match(r"[._]", x.base_name)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([before + x.path for x in found], pa.string()), pa.array([x.mtime for x in found], pa.timestamp("us", tz="UTC")), pa.array([x.size for x in found], pa.int64())],
                names=["path", "modificationTime", "length"],
            )


def files(spark: SparkSession, path: str) -> DataFrame:
    """LISTED's columns of all files below path, kept as a table. Hidden files (leading . or _) are left out.

    Stores that only Spark's own readers know are listed by Spark's file index, which knows no files without bytes.
    """
    if not _known(path):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    else:
        spark.dataSource.register(Files)
        found = spark.read.format("foliant_files").option("path", path).load()
    return saved(found, "listing")


def _written(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top, _ = opened(path)
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for key, value, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "value", "packed"))):
                folder = f"{top}/{task:06d}-{n // FEW}"
                if n % FEW == 0:
                    store.create_dir(folder)
                data = value.encode() + b"\n"
                with store.open_output_stream(f"{folder}/{key}-{n}.txt{'.gz' if packed else ''}", compression=None) as out:
                    out.write(gzip.compress(data) if packed else data)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def write_texts(rows: DataFrame, path: str) -> None:
    """One file below path for each row (key, value, packed): the value and a line feed, with gzip where packed.

    A file's name begins with its key. Tasks write FEW files to a folder, so neither a commit nor a listing has
    a folder for each text. Stores that only Spark's own writers know get a folder for each key.
    """
    if _known(path):
        rows.select(F.col("key").cast("string").alias("key"), "value", "packed").mapInArrow(_written(path), "n long").agg(F.sum("n")).collect()
        return
    for packed in (False, True):
        part = rows.filter(F.col("packed") == packed).select("key", "value").write.mode("append")
        part.option("compression", "gzip" if packed else "none").partitionBy("key").text(path)


def _removed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _, _ = opened(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                if store.get_file_info(folder).type == fs.FileType.Directory:  # else an earlier try of the task was here
                    store.delete_dir(folder)
            yield batch

    return run


def remove_texts(spark: SparkSession, path: str) -> None:
    """Delete a folder that write_texts made, what lies in it in tasks."""
    from pyarrow import fs

    if _known(path):
        store, top, _ = opened(path)
        folders = [(x.path,) for x in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if x.type == fs.FileType.Directory]
        if folders:
            spark.createDataFrame(folders, "folder string").repartition(min(len(folders), TASKS)).mapInArrow(_removed(path), "folder string").count()
    store, where = hadoop_path(spark, path)
    store.delete(where, True)


def _contents(path: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, before = opened(path)
        for batch in batches:
            held, size, first = [], 0, 0
            for i, name in enumerate(batch.column("path").to_pylist()):
                held.append(store.open_input_stream(name.removeprefix(before)).readall())
                size += len(held[-1])
                if size > SENT or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns, pa.array(held, pa.binary())], names=[*columns, "content"])
                    held, size, first = [], 0, i + 1

    return run


def reading_tasks(rows: DataFrame) -> int:
    """As many tasks as the bytes of files (length) ask for."""
    total = rows.agg(F.sum("length")).first()[0] or 0
    return int(max(rows.sparkSession.sparkContext.defaultParallelism, total // READ + 1))


def with_contents(rows: DataFrame, path: str, tasks: int | None = None, key: str = "path") -> DataFrame:
    """rows of files below path with their content, read in as many tasks as their bytes ask for.

    Rows are dealt by key before anything is read, so what a task reads is a partition by that key.
    """
    spark, tasks = rows.sparkSession, tasks or reading_tasks(rows)
    if not _known(path):
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        found = rows.join(read.select("path", "content"), "path").select(*rows.columns, "content")
        return found if key == "path" else found.repartition(tasks, key)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(tasks, key).mapInArrow(_contents(path, rows.columns), f"{kind}, content binary")
