"""Per-channel diagnostics and quality control."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.blocks import rolling, running_sum
from weftline.functions.quantiles import median_mad
from weftline.operators import clean, information, neighbors, regress, spectral
from weftline.session import staged

KEY = ["channel"]


def _slope(x, y):
    return F.try_divide(F.covar_pop(x, y), F.var_pop(x))


def hurst_aggvar(long: DataFrame, max_block: int = 100, compat: bool = False, min_n: int = 50) -> DataFrame:
    """Slope of log variance of block means against log block size: H = 1 + slope/2.

    ``compat`` gives 1 - slope/2.  Each value folds into its block inside the map stage.
    """
    c = spectral.closed_up(long)
    n = c.groupBy("channel").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    top = F.greatest(F.lit(10), F.least(F.lit(max_block), F.floor(F.col("n") / 2))).cast("int")
    rows = c.join(n, "channel").withColumn("m", F.explode(F.sequence(F.lit(1), top)))
    rows = rows.withColumn("b", F.floor(F.col("pos") / F.col("m"))).filter(F.col("b") < F.floor(F.col("n") / F.col("m")))
    means = rows.groupBy("channel", "m", "b").agg(F.avg("value").alias("v"))
    var = means.groupBy("channel", "m").agg(F.var_pop("v").alias("var"), F.count(F.lit(1)).alias("k")).filter("var > 0 AND k > 1")
    slope = _slope(F.log10("m"), F.log10("var"))
    h = (1 - slope / 2) if compat else (1 + slope / 2)
    return var.groupBy("channel").agg(F.when(F.count(F.lit(1)) >= 2, h).alias("value"))


def hurst_rs(long: DataFrame, min_window: int = 10, min_n: int = 20) -> DataFrame:
    """Rescaled range over window sizes 10^(1 + k/4) and the whole series (increments as given).

    Ranges inside a window come from a running total over the series, so windows of any size
    are plain aggregates.
    """
    c = spectral.closed_up(long)
    n = c.groupBy("channel").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    steps = F.transform(
        F.sequence(F.lit(0), F.ceil((F.log10(F.col("n") - 1) - math.log10(min_window)) / 0.25).cast("int") - 1),
        lambda k: F.floor(F.pow(F.lit(10.0), F.lit(math.log10(min_window)) + k * 0.25)),
    )
    sizes = F.array_append(steps, F.col("n"))
    s = running_sum(c, KEY, "pos", "value", "s").join(n, "channel").select("*", F.posexplode(sizes).alias("slot", "w"))
    s = s.withColumn("b", F.floor(F.col("pos") / F.col("w"))).filter((F.col("b") + 1) * F.col("w") <= F.col("n"))
    before = F.min_by(F.col("s") - F.col("value"), "pos")
    r = s.groupBy("channel", "slot", "w", "b").agg(
        (F.greatest(F.max("s"), before) - F.least(F.min("s"), before)).alias("r"), F.stddev_samp("value").alias("sd")
    )
    rs = r.filter("r > 0 AND sd > 0").groupBy("channel", "slot", "w").agg(F.avg(F.col("r") / F.col("sd")).alias("rs"))
    return rs.groupBy("channel").agg(_slope(F.log10("w"), F.log10("rs")).alias("value"))


def hurst_dfa(long: DataFrame, min_n: int = 20) -> DataFrame:
    """Detrended fluctuation exponent: half-overlapping windows, linear trend, least-squares fit.

    The residual of a line is a function of second moments, so windows are plain aggregates.
    """
    c = spectral.closed_up(long)
    s = c.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m")).filter(F.col("n") >= min_n)
    d = c.join(s, "channel").withColumn("d", F.col("value") - F.col("m"))
    walk = running_sum(d, KEY, "pos", "d", "walk")
    top = F.floor(F.ln(F.col("n") * 0.1 / 4) / math.log(1.2)).cast("int")
    grown = F.transform(F.sequence(F.lit(0), top), lambda k: F.floor(4 * F.pow(F.lit(1.2), k)).cast("int"))
    short = F.array(*[F.lit(v) for v in (4, 5, 6, 7, 8, 9)])
    sizes = F.when(F.col("n") > 70, F.array_distinct(grown)).otherwise(short)
    w = walk.withColumn("w", F.explode(sizes)).withColumn("h", F.floor(F.col("w") / 2))
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("w") + 1) / F.col("h")))
    hi = F.least(F.floor(F.col("pos") / F.col("h")), F.ceil((F.col("n") - F.col("w")) / F.col("h")) - 1)
    w = w.filter(lo <= hi).withColumn("b", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    x = F.col("pos").cast("double")
    rss = F.var_pop("walk") - F.pow(F.covar_pop("walk", x), F.lit(2)) / F.var_pop(x)
    f = w.groupBy("channel", "w", "b").agg(F.sqrt(F.greatest(F.lit(0.0), rss)).alias("f"))
    m = f.groupBy("channel", "w").agg(F.avg("f").alias("f")).filter("f > 0")
    return m.groupBy("channel").agg(_slope(F.ln("w"), F.ln("f")).alias("value"))


def quality_table(long: DataFrame, coords: DataFrame | None = None, with_adf: bool = True) -> DataFrame:
    """Missing share, mean, deviations, outliers, drift, spikes, lag-1 correlation, unit-root p per channel."""
    v, t = F.col("value"), F.col("t").cast("double")
    d = rolling(long, KEY, "t", lambda w: {"_l": F.lag("value").over(w)}, before=1)
    l = F.col("_l")
    both = v.isNotNull() & l.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, l)), F.stddev_pop(F.when(both, v))
    base = d.groupBy("channel").agg(
        F.count("value").alias("n"),
        F.avg(v.isNull().cast("double")).alias("missing_frac"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        (F.try_divide(F.covar_pop(v, t), F.var_pop(F.when(v.isNotNull(), t))) * F.stddev_pop(t)).alias("slope"),
        F.count(F.when(both, 1)).alias("pairs"),
        (F.covar_pop(l, v) / F.when((sx > 0) & (sy > 0), sx * sy)).alias("r1"),
    )
    med = median_mad(long, KEY, "value")
    rz = F.abs(v - F.col("med")) / (F.col("mad") * clean.MAD_SCALE + clean.TINY)
    out = long.join(med, "channel").groupBy("channel", "mad").agg(F.avg((rz > 3).cast("double")).alias("outlier"))
    step = d.select("channel", (v - l).alias("dx"))
    sm = median_mad(step, KEY, "dx", "dmed", "dmad")
    spikes = step.join(sm, "channel").groupBy("channel").agg(
        F.avg((F.abs(F.col("dx") - F.col("dmed")) > 5.0 * (F.col("dmad") + clean.TINY)).cast("double")).alias("spikes"),
        F.count("dx").alias("steps"),
    )
    q = base.join(out, "channel", "left").join(spikes, "channel", "left")
    robust = F.when(F.col("n") >= 5, F.col("mad") * clean.MAD_SCALE)
    table = q.select(
        F.col("channel").alias("voxel_id"),
        "missing_frac",
        "mean",
        "std",
        robust.alias("robust_std"),
        F.when(robust > clean.TINY, F.col("outlier")).alias("outlier_frac"),
        F.when(F.col("n") >= 8, F.col("slope")).alias("drift_slope"),
        F.when(F.col("steps") >= 8, F.col("spikes")).alias("spikes_frac"),
        F.when(F.col("pairs") >= 8, F.col("r1")).alias("ar1"),
        F.when(F.col("n") >= 20, F.lit(1)).alias("_adf"),
    )
    if with_adf:
        p = regress.adf(long).select(F.col("channel").alias("voxel_id"), "pvalue")
        table = table.join(p, "voxel_id", "left").withColumn("stationarity_pval", F.when(F.col("_adf") == 1, F.col("pvalue"))).drop("pvalue")
    table = table.drop("_adf")
    if coords is not None:
        table = table.join(coords.withColumnRenamed("channel", "voxel_id"), "voxel_id", "left")
    return table


def diagnostics(long: DataFrame, fs: float = 1.0) -> DataFrame:
    """One wide row per channel with every univariate measure."""
    long = staged(long)

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select("channel", F.col("value").alias(name))

    parts = [
        regress.adf(long).select("channel", F.col("stat").alias("adf_stat"), F.col("pvalue").alias("adf_p")),
        named(hurst_rs(long), "hurst_rs"),
        named(hurst_dfa(long), "hurst_dfa"),
        named(hurst_aggvar(long), "hurst_aggvar"),
        named(spectral.hurst_spectral(long), "hurst_spectral"),
        named(neighbors.sample_entropy(long), "sample_entropy"),
        named(information.shannon_entropy(long), "shannon_entropy"),
        named(information.permutation_entropy(long), "permutation_entropy"),
        spectral.seasonality(long, fs),
        regress.autocorr_summary(long),
    ]
    out = long.select("channel").distinct()
    for p in parts:
        out = out.join(staged(p), "channel", "left")
    return out


def harmonics(long: DataFrame, top_k: int = 5, fs: float = 1.0) -> DataFrame:
    return spectral.fft_peaks(long, fs, top_k)
