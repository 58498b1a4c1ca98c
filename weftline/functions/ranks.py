"""Ranks of values inside groups of any size.

Equal values are counted first, so ties cost one row.  Distinct values are then split by
sketched splitters into bounded buckets; ranks run inside a bucket and bucket totals carry
across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.blocks import positions
from weftline.functions.quantiles import ACCURACY, sketch
from weftline.functions.strips import count_below, tops
from weftline.session import pieces, staged

SPLITS = 128


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, splits: int | None = None) -> DataFrame:
    """``keys, value, cnt, rmin, rmax, dense, total, _vb`` for each distinct non-null value (ranks from 1)."""
    keys = list(keys)
    if not keys:
        return value_ranks(df.withColumn("_all", F.lit(0)), ["_all"], value, splits)
    splits = splits or pieces(df.sparkSession, SPLITS)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    cuts = counts.groupBy(*keys).agg(
        sketch(f"`{value}`", [i / splits for i in range(1, splits)], max(ACCURACY, 4 * splits)).alias("_cuts")
    )
    # staged, so that Spark sees how small they are and sends them to the values, not whole groups to one task each
    cuts = staged(cuts.withColumn("_top", tops(F.col("_cuts"))))
    bucket = count_below(F.col("_cuts"), F.col("_top"), F.col(value))
    marked = counts.join(cuts, keys).withColumn("_vb", bucket).drop("_cuts", "_top")
    sums = marked.groupBy(*keys, "_vb").agg(F.sum("cnt").alias("_s"), F.count(F.lit(1)).alias("_d"))
    below = Window.partitionBy(*keys).orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys,
        "_vb",
        F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_os"),
        F.coalesce(F.sum("_d").over(below), F.lit(0)).alias("_od"),
        F.sum("_s").over(whole).alias("total"),
    )
    local = Window.partitionBy(*keys, "_vb").orderBy(value)
    return (
        marked.repartition(*keys, "_vb")  # by bucket also where the join has dealt by key
        .withColumn("_cum", F.sum("cnt").over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rn", F.row_number().over(local))
        .join(offsets, [*keys, "_vb"])
        .select(
            *keys,
            value,
            "cnt",
            (F.col("_os") + F.col("_cum") - F.col("cnt") + 1).cast("bigint").alias("rmin"),
            (F.col("_os") + F.col("_cum")).cast("bigint").alias("rmax"),
            (F.col("_od") + F.col("_rn")).cast("bigint").alias("dense"),
            "total",
            "_vb",
        )
    )


def rank_column(
    df: DataFrame, keys: Sequence[str], value: str, ties: str = "average", order: str = "t", out: str = "rank"
) -> DataFrame:
    """Join the rank of ``value`` back to its rows; ties: average, min, max, dense, ordinal, first."""
    keys = list(keys)
    ranks = value_ranks(df, keys, value)
    if ties in ("ordinal", "first"):
        known = df.filter(F.col(value).isNotNull())
        within = positions(known.select(*keys, value, order), [*keys, value], order, out="_within")
        r = within.join(ranks.select(*keys, value, "rmin"), [*keys, value]).select(
            *keys, order, (F.col("rmin") + F.col("_within")).cast("double").alias(out)
        )
        return df.join(r, [*keys, order], "left")
    pick = {
        "average": (F.col("rmin") + F.col("rmax")) / 2.0,
        "min": F.col("rmin").cast("double"),
        "max": F.col("rmax").cast("double"),
        "dense": F.col("dense").cast("double"),
    }[ties]
    return df.join(ranks.select(*keys, value, pick.alias(out)), [*keys, value], "left")
