"""Ordered computation over long series without putting a series in one task.

A series is cut into blocks of consecutive order values.  Row-frame windows run per
block after the few rows next to a border have been copied into the neighbouring block
("halo"); totals and fills carry one summary row per block across borders.  The only
windows that see a whole series are those over block summaries, which hold one row per
``size`` positions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 16384


def block_of(order: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("bigint")


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    exprs: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    size: int = BLOCK,
) -> DataFrame:
    """Add window columns that look at most ``before`` / ``after`` order steps away.

    ``exprs`` receives the window (partitioned by keys and block, ordered by ``order``).
    Order values must be unique integers within a key; rows further away than the halo
    are not visible, so the caller states the true reach of its frame.
    """
    size = max(size, before, after, 1)
    blk = block_of(order, size)
    pos = F.pmod(F.col(order), F.lit(size))
    homes = [F.struct(blk.alias("_blk"), F.lit(True).alias("_core"))]
    if before:
        homes.append(F.when(pos >= size - before, F.struct((blk + 1).alias("_blk"), F.lit(False).alias("_core"))))
    if after:
        homes.append(F.when(pos < after, F.struct((blk - 1).alias("_blk"), F.lit(False).alias("_core"))))
    if len(homes) == 1:
        spread = df.withColumn("_blk", blk)
    else:
        spread = df.select("*", F.explode(F.array_compact(F.array(*homes))).alias("_home")).select(
            "*", F.col("_home._blk").alias("_blk"), F.col("_home._core").alias("_core")
        ).drop("_home")
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    out = spread.select("*", *[c.alias(n) for n, c in exprs(w).items()])
    if len(homes) > 1:
        out = out.filter("_core").drop("_core")
    return out.drop("_blk")


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str = "pos",
    size: int = BLOCK,
    rows: DataFrame | None = None,
) -> DataFrame:
    """Dense 0-based rank of ``order`` within ``keys`` (order values unique per key).

    ``rows`` may name a cheaper relation with the same keys and order values to count from.
    """
    keys = list(keys)
    marked = df.withColumn("_blk", block_of(order, size))
    counted = marked if rows is None else rows.withColumn("_blk", block_of(order, size))
    counts = counted.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    w_blocks = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_blk", F.coalesce(F.sum("_n").over(w_blocks), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(order))
    return (
        marked.withColumn("_rn", local)
        .join(offsets, [*keys, "_blk"])
        .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
        .drop("_blk", "_rn", "_off")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, size: int = BLOCK
) -> DataFrame:
    """Inclusive running total of ``value`` along ``order``."""
    keys = list(keys)
    marked = df.withColumn("_blk", block_of(order, size))
    sums = marked.groupBy(*keys, "_blk").agg(F.sum(value).alias("_s"))
    w_blocks = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_blk", F.coalesce(F.sum("_s").over(w_blocks), F.lit(0.0)).alias("_off"))
    local = F.sum(value).over(
        Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        marked.withColumn("_loc", local)
        .join(offsets, [*keys, "_blk"])
        .withColumn(out, F.col("_off") + F.coalesce(F.col("_loc"), F.lit(0.0)))
        .drop("_blk", "_loc", "_off")
    )


def nearest_known(
    df: DataFrame, keys: Sequence[str], order: str, value: str, size: int = BLOCK
) -> DataFrame:
    """Add ``_prev``/``_next``: struct(t, v) of the closest non-null at or before / after."""
    keys = list(keys)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("t"), F.col(value).alias("v")))
    marked = df.withColumn("_blk", block_of(order, size)).withColumn("_k", known)
    edge = marked.groupBy(*keys, "_blk").agg(F.max("_k").alias("_last"), F.min("_k").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_blk")
    edge = edge.select(
        *keys,
        "_blk",
        F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_in"),
        F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_out"),
    )
    wl = Window.partitionBy(*keys, "_blk").orderBy(order)
    return (
        marked.withColumn("_p", F.last("_k", ignorenulls=True).over(wl.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_f", F.first("_k", ignorenulls=True).over(wl.rowsBetween(0, Window.unboundedFollowing)))
        .join(edge, [*keys, "_blk"])
        .withColumn("_prev", F.coalesce("_p", "_in"))
        .withColumn("_next", F.coalesce("_f", "_out"))
        .drop("_blk", "_k", "_p", "_f", "_in", "_out")
    )
