"""Tables in the shared folder: what loops build on, and what is written once and found again."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}
NAMED = re.compile(r"[a-z0-9-]+-[0-9a-f]{32}")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is named, one of our own in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named.rstrip("/") if named else _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="foliant-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Write df to the shared folder, in folders by the partition columns, and read it back.

    This cuts the lineage with files that outlive any executor, keeps later reads from computing df
    again, and tells the planner its true size, by which it picks a broadcast or a shuffled join.
    """
    path = new_folder(df.sparkSession, name)
    (df.write.partitionBy(*partition) if partition else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like saved, in buckets of a key: joins, groups and windows by that key read the table without a shuffle.

    df should come in as many partitions by that key, so that a task writes one bucket. Buckets have to be known to
    the session's catalog; spent takes the table out of it.
    """
    path = new_folder(df.sparkSession, name)
    table = f"spark_catalog.default.{path.rsplit('/', 1)[1].replace('-', '_')}"
    df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    out = df.sparkSession.table(table)
    out._saved_at, out._table = path, table
    return out


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table, so that plans of loops stay short and lost executors cost no more."""
    return saved(df, "settled")


def hadoop_path(spark: SparkSession, path: str):
    """The file system that holds a path, and the path, as Spark knows them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def spent(*tables: DataFrame) -> None:
    """Delete saved tables from which nothing is computed any more."""
    for df in tables:
        if table := getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        store, where = hadoop_path(df.sparkSession, df._saved_at)
        store.delete(where, True)


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Give a folder its final name in one step; if that name is taken, delete the folder and say False."""
    store, where = hadoop_path(spark, old)
    target = hadoop_path(spark, new)[1]
    if not store.exists(target) and store.rename(where, target) and not store.exists(hadoop_path(spark, f"{new}/{where.getName()}")[1]):
        return True
    store.delete(where, True)
    store.delete(hadoop_path(spark, f"{new}/{where.getName()}")[1], True)  # where a rename moves into a folder that came first
    return False


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    store, where = hadoop_path(spark, path)
    return store.exists(where)


def purge(spark: SparkSession, older_than: timedelta, now: datetime | None = None) -> list[str]:
    """Delete what this library left in the shared folder and nothing has written to since; returns the names.

    Only folders that new_folder names (a word and an id) and drafts of indexes count, by the newest time of the
    folder and the files right in it, so tables that a running job still writes stay. Indexes stay: they are found again.
    """
    limit = ((now or datetime.now(UTC)) - older_than).timestamp() * 1000
    store, top = hadoop_path(spark, shared_folder(spark))
    gone = []
    folders = [(top, NAMED)] + [(hadoop_path(spark, f"{shared_folder(spark)}/indexes")[1], re.compile(r"draft-[0-9a-f]{32}"))]
    for folder, named in folders:
        for x in store.listStatus(folder) if store.exists(folder) else []:
            path = x.getPath()
            if x.isDirectory() and named.fullmatch(path.getName()):
                newest = max([x.getModificationTime(), *(y.getModificationTime() for y in store.listStatus(path))])
                if newest < limit and store.delete(path, True):
                    gone.append(path.getName())
    return sorted(gone)
