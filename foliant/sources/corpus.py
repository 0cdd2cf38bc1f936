"""Raw text files in, derived tables out, and their expiry."""

from __future__ import annotations

import json
import re
import uuid
from datetime import timedelta

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, is_readable, normalize_newlines
from ..stages import hadoop_path, saved
from .listing import files, with_contents

MAX_BYTES = 50 * 1024 * 1024
CASCADE = ("gb18030", "big5")
#: Tried last: encodings that accept few texts of others, then one that accepts nearly all.
LAST_RESORT = ("utf-16-le", "utf-16-be", "shift_jis", "euc_kr", "cp1251", "cp1252")


def judged(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of path and length with filename and the reason to reject them, null for accepted ones."""
    name = F.try_element_at(F.split("path", "/"), F.lit(-1))
    media = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    reason = (
        F.when(media != "txt", "wrong_suffix").when(F.col("length") == 0, "empty").when(F.length(name) > 255, "name_too_long")
        .when(name.rlike(r"[\x00-\x1F]"), "bad_name").when(F.col("length") > max_bytes, "too_large")
    )
    return files.withColumns({"filename": name, "reason": reason})


def read_txt_corpus(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted: book_id, path, filename, size_bytes, modified_at, content; rejected: path, filename, size_bytes, reason).

    All files below path are listed, in tasks, so that rejects are on record; contents are read of accepted ones only.
    """
    rows = judged(files(spark, path), max_bytes)
    good = rows.filter("reason is null").select(F.md5(F.col("path").cast("binary")).alias("book_id"), "path", "filename", "length", "modificationTime")
    accepted = with_contents(good, path).select("book_id", "path", "filename", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    return accepted, rows.filter("reason is not null").select("path", "filename", F.col("length").alias("size_bytes"), "reason")


def _legacy(data: bytes) -> tuple[str | None, str | None]:
    """Text and encoding of bytes that are not UTF-8: by byte order mark, then the cascade, strictly."""
    tries = ("utf-16",) if data[:2] in (b"\xff\xfe", b"\xfe\xff") else CASCADE
    for encoding in tries:
        if (text := _readable(data, encoding)) is not None:
            return text, encoding
    # a detector of last resort: of the readable decodings, the one with the largest share of ordinary letters
    found = [(_plain_share(text), -i, text, encoding) for i, encoding in enumerate(LAST_RESORT) if (text := _readable(data, encoding)) is not None]
    best = max(found, default=None)
    return (best[2], best[3]) if best and best[0] >= 0.8 else (None, None)


def _readable(data: bytes, encoding: str) -> str | None:
    try:
        text = data.decode(encoding)
    except UnicodeDecodeError:
        return None
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    controls = sum(c < " " and c not in "\n\t" for c in plain)
    return text if plain.strip() and controls <= max(5, len(plain) // 100) else None


def _plain_share(text: str) -> float:
    """The share of characters that are white space, ASCII, or letters beside letters of the same script."""
    scripts = [0 if c.isspace() or " " <= c < "\x7f" else ord(c) // 512 + 1 if c.isalpha() else -1 for c in text]
    common = max(set(scripts) - {0, -1}, key=scripts.count, default=0)
    return sum(s == 0 or s == common for s in scripts) / len(text)


def decoded(files: DataFrame) -> DataFrame:
    """files with text, encoding and character_count instead of content, all three null where no encoding fits.

    Each content is read once. UTF-8 is checked and decoded by built-in functions; only other files reach Python.
    """
    bom = F.substring(F.hex("content"), 1, 6) == "EFBBBF"
    body = F.when(bom, F.expr("substring(content, 4)")).otherwise(F.col("content"))
    direct = F.expr("is_valid_utf8(cast(content as string))") & ~F.substring(F.hex(F.expr("substring(content, 1, 2)")), 1, 4).isin("FFFE", "FEFF")
    text = normalize_newlines(body.cast("string"))
    rows = files.withColumn("__text", F.when(direct, text)).withColumn("__direct", is_readable(F.col("__text")))

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
    def legacy(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if c is None else _legacy(bytes(c)) for c in contents], columns=["text", "encoding"])

    rows = rows.withColumn("__d", legacy(F.when(~F.col("__direct"), F.col("content")))).withColumns({
        "text": F.when(F.col("__direct"), F.col("__text")).otherwise(normalize_newlines(F.col("__d.text"))),
        "encoding": F.when(F.col("__direct"), F.when(bom, "utf-8-sig").otherwise("utf-8")).otherwise(F.col("__d.encoding")),
    })
    return rows.drop("__text", "__direct", "__d", "content").withColumn("character_count", F.length("text").cast("bigint"))


def sorted_out(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with their text; files that no encoding fits, with reason)."""
    bad = decoded.filter("text is null").drop("text", "encoding", "character_count")
    return decoded.filter("text is not null"), bad.withColumn("reason", F.lit("undecodable"))


def decode_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with text, encoding and character_count instead of content; files that no encoding fits, with reason)."""
    return sorted_out(decoded(files))


class Conflict(RuntimeError):
    """Another writer committed the same buckets in between, again and again."""


def _manifest(spark: SparkSession, stage: str, version: int | None = None) -> tuple[int, dict[str, str]]:
    """Version and bucket folders of a snapshot, the newest unless a version is named; 0 and none where there is none."""
    store, folder = hadoop_path(spark, f"{stage}/_versions")
    if not store.exists(folder):
        return 0, {}
    names = [x.getPath().getName() for x in store.listStatus(folder)]
    versions = [int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n)]
    if version is None:
        version = max(versions, default=0)
    if version not in versions:
        return 0, {}
    stream = store.open(hadoop_path(spark, f"{stage}/_versions/{version}.json")[1])
    try:
        return version, json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, stage: str, version: int, buckets: dict[str, str]) -> bool:
    """Make a snapshot the next version; False if that version is there already."""
    draft = f"{stage}/_drafts/{uuid.uuid4().hex}.json"
    store, where = hadoop_path(spark, draft)
    stream = store.create(where, False)
    stream.write(bytearray(json.dumps(buckets, sort_keys=True).encode()))
    stream.close()
    final = hadoop_path(spark, f"{stage}/_versions/{version}.json")[1]
    store.mkdirs(final.getParent())
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.NONE  # never over another file
    try:
        context.rename(store.makeQualified(where), store.makeQualified(final), options)
    except Py4JJavaError as e:
        if not store.exists(final):
            raise e
        store.delete(where, False)
        return False
    return True


def _snapshot(spark: SparkSession, stage: str, buckets: dict[str, str], schema: T.StructType | str) -> DataFrame:
    if not buckets:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema).option("basePath", f"{stage}/data").parquet(*(f"{stage}/data/{folder}/bucket={b}" for b, folder in buckets.items()))
    return read.drop("write")


def read_stage(spark: SparkSession, root: str, name: str, schema: T.StructType | str, version: int | None = None) -> DataFrame:
    """The newest snapshot of a stage, or an earlier version: always one whole commit, whatever is being written."""
    return _snapshot(spark, f"{root}/{name}", _manifest(spark, f"{root}/{name}", version)[1], schema)


def write_stage(df: DataFrame, root: str, name: str, buckets: int = 64, key: str = "book_id", tries: int = 5) -> int:
    """Replace the rows of the keys in df and leave all others as they are; returns the version that was written.

    Only the buckets that hold such keys are read and written again, into folders of their own. A version
    is a small file that names the folder of each bucket; it appears in one step and only as the successor of
    the one that was read. Where another writer was first, its version is read: if it left the buckets of df
    alone, the new folders count on top of it, otherwise the merge is done again. So writers lose no rows, and
    readers see one version or the next. Earlier versions stay until clean_stage.
    """
    stage, spark = f"{root}/{name}", df.sparkSession
    out = saved(df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "stage-rows")
    mine = [str(r.bucket) for r in out.select("bucket").distinct().collect()]  # buckets at most
    parent, held = _manifest(spark, stage)
    for _ in range(tries):
        base = {b: held.get(b) for b in mine}
        others = _snapshot(spark, stage, {b: f for b, f in base.items() if f}, out.schema)
        rows = out.unionByName(others.join(out.select(key).distinct(), key, "left_anti"))
        folder = f"write={uuid.uuid4().hex}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{stage}/data/{folder}")
        while {b: held.get(b) for b in mine} == base:
            if _commit(spark, stage, parent + 1, held | dict.fromkeys(mine, folder)):
                return parent + 1
            parent, held = _manifest(spark, stage)
    raise Conflict(f"{stage}: {tries} tries")


def clean_stage(spark: SparkSession, root: str, name: str, keep: int = 2) -> list[str]:
    """Delete all but the last `keep` versions and the folders that none of those names; returns these folders.

    Not while writers are at work: their folders are not named yet.
    """
    stage = f"{root}/{name}"
    newest, _ = _manifest(spark, stage)
    used = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in _manifest(spark, stage, v)[1].values()}
    store, versions = hadoop_path(spark, f"{stage}/_versions")
    for x in store.listStatus(versions):
        if int(x.getPath().getName()[:-5]) <= newest - keep:
            store.delete(x.getPath(), False)
    gone = [x.getPath() for x in store.listStatus(hadoop_path(spark, f"{stage}/data")[1]) if x.getPath().getName() not in used]
    for path in gone:
        store.delete(path, True)
    return sorted(p.getName() for p in gone)


def expire(books: DataFrame, now: Column, ttl: timedelta) -> tuple[DataFrame, DataFrame]:
    """(live, expired): expires_at, or modified_at + ttl where it is missing, not after now."""
    seconds = ttl.total_seconds()
    until = F.coalesce("expires_at", F.col("modified_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))
    rows = books.withColumn("__until", until)
    return rows.filter(F.col("__until") > now).drop("__until"), rows.filter(F.col("__until") <= now).drop("__until")


def purge(children: DataFrame, expired: DataFrame, key: str = "book_id") -> DataFrame:
    return children.join(expired.select(key), key, "left_anti")


TRACE = "time timestamp, kind string, task_id string, status string, duration_ms double, estimated_tokens bigint, measured_tokens bigint"


TRACE_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]"


def read_trace(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Trace records of JSON lines; in batch sorted by time."""
    if stream:
        return spark.readStream.schema(TRACE).option("timestampFormat", TRACE_TIME).json(path)
    return spark.read.schema(TRACE).option("timestampFormat", TRACE_TIME).json(path).orderBy("time", "kind", "task_id")


def blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{SPACE}]")
