"""Helpers shared by the operators: staged tables, Arrow settings, sizes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_ROWS = 512
BATCH_BYTES = 8 << 20

_staged: dict[str, list[str]] = {}
_own_folder: list[str] = []


def ready(spark: SparkSession) -> SparkSession:
    """Settings for bounded Arrow batches; memory and partition counts stay the cluster's."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="weftline-llm-"))
    return _own_folder[0]


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write to the shared folder once and read back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables staged so far; call it when every result built on them has been written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _staged.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces_for(spark: SparkSession, amount: float, per_piece: float) -> int:
    """Pieces that grow with the data: ``per_piece`` bounds one piece, the session's setting is the least."""
    return max(shuffle_parts(spark), int(amount // per_piece) + 1)


def with_row(held: DataFrame, rest: str) -> StructType:
    """Schema of the struct ``row`` of ``held``, whatever its columns are called, and the columns of ``rest``."""
    return StructType([held.schema["row"], *StructType.fromDDL(rest).fields])


def blank_null(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (two multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as one byte array and its row offsets; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_runs(data: np.ndarray, offsets: np.ndarray, inside_of: np.ndarray):
    """Words of all rows at once: runs of bytes (A-Z lowered) that ``inside_of`` allows.

    Returns the lowered bytes, word starts, word ends, the row of each word and a hash of each word.
    """
    low = LOWER[data]
    inside = inside_of[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        return low, starts, ends, row, np.empty(0, np.uint64)
    lengths = ends - starts
    at = np.flatnonzero(inside)
    within = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), STEP, np.uint64), dtype=np.uint64)
    sums = np.add.reduceat(BYTE[low[at]] * powers[within], np.cumsum(lengths) - lengths)
    return low, starts, ends, row, mix64(sums + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, whatever row they belong to."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * STEP + words[k : k + n]
    return mix64(out)


def numbered(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """``key, at`` and ``keep`` of all rows sorted by key and ``order`` (nulls first), with ``pos`` inside the key and its ``total``.

    Rows are dealt by ranges, so a key with most of the rows lies in many partitions; a row's number is
    its place in its partition plus what earlier partitions hold of its key.  ``at`` is the place over all.
    """
    spark = rows.sparkSession
    held = staged(rows.withColumn("_uid", F.monotonically_increasing_id()), "unsorted")
    by = [F.col(c).asc_nulls_first() for c in (key, *order, "_uid")]
    parts = pieces_for(spark, held.count(), 1 << 20)
    dealt = held.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    dealt = staged(dealt.select(key, *keep, F.monotonically_increasing_id().alias("at")), "sorted")
    # one column for the key, so that null keys meet too
    own = dealt.withColumn("_run", F.struct(F.shiftright("at", 33).alias("part"), F.col(key).alias("key")))
    runs = own.groupBy("_run").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_key = W.partitionBy("_run.key")
    runs = runs.select("_run", "first", (F.sum("n").over(of_key.orderBy("_run.part")) - F.col("n")).alias("before"), F.sum("n").over(of_key).alias("total"))
    return own.join(runs, "_run").select(key, *keep, "at", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "total")


def attach(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with ``right``, which has each key once; ``left`` may hold a key in any share of its rows.

    Keys with more rows than an even partition would have are fewer than the partitions, so their list is
    broadcast; their rows are dealt over salts and their row of ``right`` goes along once per salt.
    """
    parts = shuffle_parts(left.sparkSession)
    total = left.count()
    counted = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") * parts > total)
    hot = F.broadcast(counted.select(key, F.ceil(F.col("_n") * parts / total).cast("long").alias("_salts")))
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0).cast("long")).alias("_salt")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1).cast("long")) - 1)).alias("_salt")
    dealt = left.join(hot, key, "left").select(*left.columns, salt)
    copies = right.join(hot, key, "left").select(*right.columns, salts)
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")
