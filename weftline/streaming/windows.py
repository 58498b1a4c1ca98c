"""The bucketed panel and windowed correlation on a stream.

The batch operators run on a panel of time buckets; here the same buckets are kept by event
time with a watermark, and correlation per sliding window is kept as mergeable sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.panel import clamped, finite


def bucket_panel(
    events: DataFrame, ts: str, channel: str, value: str, channels: Sequence[str], bucket: str = "1 hour", watermark: str = "10 minutes"
) -> DataFrame:
    """Wide buckets ``bucket, <channel means>``, emitted once the watermark has passed them."""
    cells = [F.avg(F.when(F.col(channel) == c, finite(F.col(value)))).alias(c) for c in channels]
    w = events.withWatermark(ts, watermark).groupBy(F.window(ts, bucket).alias("w")).agg(*cells)
    return w.select(F.col("w.start").alias("bucket"), *[F.col(f"`{c}`") for c in channels])


def window_correlation(panel: DataFrame, bucket: str, pairs: Sequence[tuple[str, str]], size: str, slide: str, watermark: str = "10 minutes") -> DataFrame:
    """``start, src, dst, value``: Pearson r of bucket values in sliding event-time windows."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in pairs])
    )
    pts = panel.withWatermark(bucket, watermark).select(bucket, cells.alias("c")).select(bucket, "c.*").filter("x IS NOT NULL AND y IS NOT NULL")
    s = pts.groupBy(F.window(bucket, size, slide).alias("w"), "src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")
    )
    ok = (F.col("n") >= 3) & (F.col("sx") > 1e-12) & (F.col("sy") > 1e-12)
    return s.select(F.col("w.start").alias("start"), "src", "dst", clamped(F.col("c") / F.when(ok, F.col("sx") * F.col("sy")), -1.0, 1.0).alias("value"))
