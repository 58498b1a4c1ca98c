"""Exact linear-interpolated quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task.  Here a bounded sketch
first brackets the wanted order statistics; then one counting pass keeps exact counts of
only the values inside the bracket (everything below collapses to a single counter before
the shuffle), so a reducer sees well under one percent of a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import pieces

GRID = 512
ACCURACY = 2000


def sketch(value: str, probs: Sequence[float], accuracy: int = ACCURACY) -> Column:
    """Approximate quantiles as one SQL expression (many probabilities, one call)."""
    return F.expr(f"percentile_approx({value}, array({', '.join(f'{p}D' for p in probs)}), {accuracy})")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    bounded: bool = False,
) -> DataFrame:
    """One row per group: the keys plus one column per entry of ``probs``.

    ``bounded=True`` is for groups with a proven small size (a window of w rows, one row
    per channel pair) where the plain aggregate is the better plan.
    """
    keys = list(keys)
    names = list(probs)
    if bounded:
        return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()])

    if not keys:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs).drop("_all")

    cells = pieces(df.sparkSession, GRID)
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    grid = data.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        sketch("_v", [i / cells for i in range(cells + 1)], max(ACCURACY, 4 * cells)).alias("_g"),
    )

    n, grid_at = F.col("_n"), F.col("_g")
    pos = lambda p: p * (n - 1)

    def bracket(p, i):
        k = F.floor(pos(p)) + 1
        lo = (F.floor((k - 2) / n * cells) - 1).cast("int")
        hi = (F.ceil((k + 2) / n * cells) + 1).cast("int")
        return F.struct(
            i.alias("i"),
            k.alias("k"),
            (pos(p) - F.floor(pos(p))).alias("frac"),
            F.when(lo < 1, F.col("_min")).otherwise(F.get(grid_at, lo)).alias("lo"),
            F.when(hi > cells - 1, F.col("_max")).otherwise(F.get(grid_at, hi)).alias("hi"),
        )

    wanted = F.lit([float(probs[m]) for m in names])
    plan = grid.select(*keys, F.transform(wanted, bracket).alias("_b"))
    joined = data.join(plan, keys)
    hits = joined.select(*keys, "_v", F.explode("_b").alias("_e")).filter("_v <= _e.hi").select(
        *keys, F.col("_e.i").alias("_i"), F.col("_e.k").alias("_k"), F.col("_e.frac").alias("_frac"), F.when(F.col("_v") >= F.col("_e.lo"), F.col("_v")).alias("_v")
    )
    counts = hits.groupBy(*keys, "_i", "_k", "_frac", "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys, "_i", "_k", "_frac").orderBy(F.col("_v").asc_nulls_first())
    cum = counts.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stats = cum.groupBy(*keys, "_i", "_k", "_frac").agg(
        F.max(F.when(F.col("_v").isNull(), F.col("_cum"))).alias("_below"),
        F.min(F.when(F.col("_cum") >= F.col("_k"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") >= F.col("_k") + 1, F.col("_v"))).alias("_z"),
    )
    exact = (
        F.when(F.col("_below") >= F.col("_k"), F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
        .when(F.col("_a").isNull(), F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
        .otherwise(F.col("_a") + F.col("_frac") * (F.coalesce("_z", "_a") - F.col("_a")))
    )
    vals = stats.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", exact.alias("q")))).alias("_q"))
    return vals.select(*keys, *[F.col("_q")[i].alias(m) for i, m in enumerate(names)])


def median_mad(df: DataFrame, keys: Sequence[str], value: str, med: str = "med", mad: str = "mad") -> DataFrame:
    """Per group: median and the median absolute deviation from it (unscaled)."""
    keys = list(keys)
    centre = quantiles(df, keys, value, {med: 0.5})
    dev = df.join(centre, keys).withColumn("_dev", F.abs(F.col(value) - F.col(med)))
    return quantiles(dev, [*keys, med], "_dev", {mad: 0.5})
