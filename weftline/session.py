"""Session settings the operators rely on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive features every plan here counts on.

    Shuffle partition counts, memory and the checkpoint folder belong to the cluster,
    so they are left as the session has them.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # rows here cost far more to compute than to move, so small shuffles keep their parallelism
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def local_session(app: str = "weftline", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", os.environ.get("WEFTLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not _own_folder:
        import tempfile

        _own_folder.append("file://" + tempfile.mkdtemp(prefix="weftline-stage-"))
    return _own_folder[0]


def staged(df: DataFrame) -> DataFrame:
    """Write an expensive intermediate once as Parquet; later branches read the columns and rows they need."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(spark: SparkSession, least: int) -> int:
    """Into how many pieces to cut a group: as many as the session shuffles into, which follows the data, and ``least`` at least."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *columns) -> DataFrame:
    """Partition by the columns over all shuffle partitions.

    Adaptive execution merges partitions by bytes; groups that are small but costly to compute
    would end up in a few tasks, so their partition count is stated.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
