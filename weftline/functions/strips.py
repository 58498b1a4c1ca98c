"""Cutting groups into strips of bounded size along a value.

A sketch per group gives splitters.  A splitter value that repeats marks a heavy value and
gets a strip of its own (odd code); other values fall between splitters (even code).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.quantiles import ACCURACY, sketch
from weftline.session import pieces

GRID = 256


WIDTH = 16  # splitters compared at once by count_below


def tops(cuts: Column) -> Column:
    """Last splitter of each run of ``WIDTH``."""
    return F.filter(cuts, lambda s, i: (i + 1) % WIDTH == 0)


def count_below(cuts: Column, top: Column, v: Column) -> Column:
    """How many sorted splitters lie below v, in two short scans instead of one long one."""
    runs = F.size(F.filter(top, lambda s: s < v))
    rest = F.slice(cuts, runs * WIDTH + 1, WIDTH)
    return runs * WIDTH + F.size(F.filter(rest, lambda s: s < v))


def _same_as_before(values: Column):
    return lambda s, i: (i > 0) & (F.get(values, i - 1) == s)


def add_splitters(
    points: DataFrame, keys: Sequence[str], values: Sequence[str], target: int | Column, grid: int | None = None
) -> DataFrame:
    """Join ``n`` and, per value, its distinct splitters, their tops and the repeated ones onto the points.

    The number of strips is about n / target (a number or an expression over ``n``), at most ``grid``
    (none given: 256, or the session's shuffle partitions if those are more).
    """
    keys = list(keys)
    grid = grid or pieces(points.sparkSession, GRID)
    probs = [i / grid for i in range(1, grid)]
    stats = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[sketch(v, probs, max(ACCURACY, 4 * grid)).alias(f"_g_{v}") for v in values]
    )
    strips = F.greatest(F.lit(1), F.least(F.lit(grid), F.ceil(F.col("n") / target)))
    step = F.ceil(F.lit(grid) / strips).cast("int")
    for v in values:
        stats = stats.withColumn(f"_p_{v}", F.filter(f"_g_{v}", lambda s, i: (i + 1) % step == 0))
    cols = []
    for v in values:
        picked = F.col(f"_p_{v}")
        cut = F.array_distinct(picked)
        repeated = F.array_distinct(F.filter(picked, _same_as_before(picked)))
        cols += [cut.alias(f"cut_{v}"), tops(cut).alias(f"top_{v}"), repeated.alias(f"rep_{v}")]
    return points.join(stats.select(*keys, "n", *cols), keys)


def strip_code(value: str) -> Column:
    """Even: number of splitters below the value, doubled; odd: the value is a splitter."""
    v = F.col(value)
    below = count_below(F.col(f"cut_{value}"), F.col(f"top_{value}"), v)
    hit = F.coalesce(F.get(f"cut_{value}", below) == v, F.lit(False))
    return below * 2 + hit.cast("int")


def heavy_code(value: str) -> Column:
    """Like ``strip_code`` but odd only for splitters that repeat, so odd strips are never tiny."""
    v = F.col(value)
    below = count_below(F.col(f"cut_{value}"), F.col(f"top_{value}"), v)
    return below * 2 + F.array_contains(f"rep_{value}", v).cast("int")
