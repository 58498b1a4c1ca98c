"""Per-channel cleaning on the long panel ``t, channel, value``.

Each operator takes and returns a long panel.  Whole-channel statistics are a
map-side-combined aggregate joined back on the channel; neighbour rules use block windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.blocks import nearest_known, rolling
from weftline.functions.quantiles import median_mad, quantiles
from weftline.functions.ranks import rank_column

KEY = ["channel"]
TINY = 1e-12
MAD_SCALE = 1.4826


def _stats(df: DataFrame, **aggs: Column) -> DataFrame:
    return df.groupBy("channel").agg(*[c.alias(n) for n, c in aggs.items()])


def _put(df: DataFrame, value: Column) -> DataFrame:
    return df.select("t", "channel", value.alias("value"))


def centered(window: int) -> tuple[int, int]:
    """Rows before and after the current one in a centred frame of ``window`` rows."""
    ahead = (window - 1) // 2
    return window - 1 - ahead, ahead


# -- row and channel filters ------------------------------------------------------------


def time_slice(df: DataFrame, start: int = 0, end: int | None = None, stride: int = 1) -> DataFrame:
    """Half-open slice of positions; kept positions are renumbered from 0."""
    keep = F.col("t") >= start
    if end is not None:
        keep &= F.col("t") < end
    keep &= (F.col("t") - start) % stride == 0
    return df.filter(keep).withColumn("t", ((F.col("t") - start) / stride).cast("bigint"))


def drop_empty_channels(df: DataFrame) -> DataFrame:
    return df.join(_stats(df, n=F.count("value")).filter("n > 0").select("channel"), "channel", "left_semi")


def drop_empty_rows(df: DataFrame) -> DataFrame:
    keep = df.groupBy("t").agg(F.count("value").alias("n")).filter("n > 0").select("t")
    return df.join(keep, "t", "left_semi")


def valid_fraction(df: DataFrame) -> DataFrame:
    return _stats(df, valid_frac=F.avg(F.col("value").isNotNull().cast("double")))


def drop_sparse_channels(df: DataFrame, min_valid: float = 0.2) -> DataFrame:
    keep = valid_fraction(df).filter(F.col("valid_frac") >= min_valid).select("channel")
    return df.join(keep, "channel", "left_semi")


def drop_constant_channels(df: DataFrame) -> DataFrame:
    keep = _stats(df, lo=F.min("value"), hi=F.max("value")).filter("lo < hi").select("channel")
    return df.join(keep, "channel", "left_semi")


def distinct_fraction(df: DataFrame) -> DataFrame:
    """Distinct non-null values over all rows.  Two plain aggregates: no group holds a set."""
    distinct = df.filter("value IS NOT NULL").select("channel", "value").distinct()
    d = distinct.groupBy("channel").agg(F.count(F.lit(1)).alias("d"))
    n = _stats(df, n=F.count(F.lit(1)))
    return n.join(d, "channel", "left").select("channel", (F.coalesce("d", F.lit(0)) / F.col("n")).alias("uniq_frac"))


def drop_near_constant(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    keep = distinct_fraction(df).filter(F.col("uniq_frac") >= threshold).select("channel")
    return df.join(keep, "channel", "left_semi")


def top_channels(df: DataFrame, k: int, by: str = "variance", seed: int = 13) -> DataFrame:
    """Channels kept by a feature limit: largest sample variance, first by name, or hashed order."""
    if by == "variance":
        ranked = _stats(df, score=F.var_samp("value")).orderBy(F.desc("score"), "channel")
    elif by == "activity":
        ranked = _stats(df, score=F.sum(F.abs("value"))).orderBy(F.desc("score"), "channel")
    elif by == "random":
        ranked = _stats(df, score=F.count(F.lit(1))).orderBy(F.xxhash64("channel", F.lit(seed)), "channel")
    else:
        ranked = _stats(df, score=F.count(F.lit(1))).orderBy("channel")
    return ranked.limit(k)


def limit_channels(df: DataFrame, k: int, by: str = "variance", seed: int = 13) -> DataFrame:
    return df.join(top_channels(df, k, by, seed).select("channel"), "channel", "left_semi")


# -- filling and simple transforms ------------------------------------------------------


def fill_mean(df: DataFrame) -> DataFrame:
    return _put(df.join(_stats(df, m=F.avg("value")), "channel"), F.coalesce("value", "m"))


def fill_linear(df: DataFrame) -> DataFrame:
    """Interior gaps linear in position, edges copy the nearest value, empty channels 0."""
    f = nearest_known(df, KEY, "t", "value")
    p, n = F.col("_prev"), F.col("_next")
    span = (n["t"] - p["t"]).cast("double")
    lerp = p["v"] + (n["v"] - p["v"]) * F.try_divide((F.col("t") - p["t"]).cast("double"), span)
    filled = F.coalesce("value", F.when(p.isNotNull() & n.isNotNull(), lerp), p["v"], n["v"], F.lit(0.0))
    return _put(f, filled)


def log_positive(df: DataFrame) -> DataFrame:
    v = F.col("value")
    return _put(df, F.when(v > 0, F.ln(v)).otherwise(v))


def auto_log_flags(df: DataFrame) -> DataFrame:
    """Channels whose values are all present and positive and whose log is less skewed."""
    v = F.col("value")
    pos = F.when(v > 0, F.ln(v))
    return _stats(
        df,
        n=F.count(F.lit(1)),
        npos=F.count(pos),
        skew=F.when(F.var_pop(v) > 0, F.skewness(v)),
        log_skew=F.when(F.var_pop(pos) > 0, F.skewness(pos)),
    ).withColumn("use_log", F.coalesce((F.col("n") == F.col("npos")) & (F.abs("log_skew") < F.abs("skew")), F.lit(False)))


def auto_log(df: DataFrame) -> DataFrame:
    flags = auto_log_flags(df).select("channel", "use_log")
    return _put(df.join(flags, "channel"), F.when(F.col("use_log"), F.ln(F.col("value"))).otherwise(F.col("value")))


def difference(df: DataFrame) -> DataFrame:
    """First difference; the first position becomes 0, a step next to a gap stays missing."""
    d = rolling(df, KEY, "t", lambda w: {"_l": F.lag("value").over(w)}, before=1)
    return _put(d, F.when(F.col("t") == 0, F.lit(0.0)).otherwise(F.col("value") - F.col("_l")))


def difference_standardized(df: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Difference, remove the mean, divide by the sample deviation (for channels in ``only``)."""
    target = df if only is None else df.filter(F.col("channel").isin(only))
    d = difference(target)
    s = _stats(d, m=F.avg("value"), s=F.stddev_samp("value"))
    scaled = _put(d.join(s, "channel"), (F.col("value") - F.col("m")) / F.when(F.col("s") > TINY, F.col("s")).otherwise(1.0))
    return scaled if only is None else scaled.unionByName(df.filter(~F.col("channel").isin(only)))


# -- outliers ---------------------------------------------------------------------------


def _abs_diff(df: DataFrame) -> DataFrame:
    return rolling(df, KEY, "t", lambda w: {"_d": F.abs(F.col("value") - F.lag("value").over(w))}, before=1)


def outlier_mask(
    df: DataFrame,
    rule: str,
    z: float = 5.0,
    k: float = 1.5,
    abs_thr: float | None = None,
    p_low: float = 0.5,
    p_high: float = 99.5,
    hampel_window: int = 7,
    jump_thr: float | None = None,
) -> DataFrame:
    """``t, channel, value, is_out`` under one of the seven rules."""
    v = F.col("value")
    if rule == "zscore":
        s = _stats(df, m=F.avg(v), s=F.stddev_pop(v))
        out = df.join(s, "channel").withColumn("is_out", F.abs(v - F.col("m")) / (F.col("s") + TINY) > z)
    elif rule in ("robust_z", "mad"):
        out = df.join(median_mad(df, KEY, "value"), "channel", "left").withColumn(
            "is_out", F.abs(v - F.col("med")) / (F.col("mad") * MAD_SCALE + TINY) > z
        )
    elif rule == "iqr":
        q = quantiles(df, KEY, "value", {"q1": 0.25, "q3": 0.75})
        w = F.col("q3") - F.col("q1") + TINY
        out = df.join(q, "channel", "left").withColumn("is_out", (v < F.col("q1") - k * w) | (v > F.col("q3") + k * w))
    elif rule == "percentile":
        q = quantiles(df, KEY, "value", {"lo": p_low / 100, "hi": p_high / 100})
        out = df.join(q, "channel", "left").withColumn("is_out", (v < F.col("lo")) | (v > F.col("hi")))
    elif rule == "abs":
        out = df.withColumn("is_out", F.lit(False) if abs_thr is None else F.abs(v) > abs_thr)
    elif rule == "hampel":
        b, a = centered(max(3, hampel_window))
        med = rolling(df, KEY, "t", lambda w: {"_m": F.percentile("value", F.lit(0.5)).over(w.rowsBetween(-b, a))}, b, a)
        med = med.withColumn("_e", F.abs(v - F.col("_m")))
        mad = rolling(med, KEY, "t", lambda w: {"_s": F.percentile("_e", F.lit(0.5)).over(w.rowsBetween(-b, a))}, b, a)
        out = mad.withColumn("is_out", F.col("_e") / (F.col("_s") * MAD_SCALE + TINY) > z)
    elif rule == "jump":
        d = _abs_diff(df)
        if jump_thr is not None:
            out = d.withColumn("is_out", F.col("_d") > jump_thr)
        else:
            s = median_mad(d, KEY, "_d")
            out = d.join(s, "channel", "left").withColumn(
                "is_out", F.col("_d") > F.col("med") + z * (F.col("mad") * MAD_SCALE + TINY)
            )
    else:
        raise ValueError(f"unknown outlier rule {rule!r}")
    return out.select("t", "channel", "value", F.coalesce("is_out", F.lit(False)).alias("is_out"))


def outliers(
    df: DataFrame,
    rule: str,
    action: str = "mask",
    p_low: float = 0.5,
    p_high: float = 99.5,
    local_median_window: int = 7,
    **rule_args,
) -> DataFrame:
    """Replace flagged values: mask, median, local_median, clip / winsorize."""
    m = outlier_mask(df, rule, p_low=p_low, p_high=p_high, **rule_args)
    v, bad = F.col("value"), F.col("is_out")
    if action in ("mask", "nan"):
        return _put(m, F.when(~bad, v))
    if action == "median":
        q = quantiles(df, KEY, "value", {"med": 0.5})
        return _put(m.join(q, "channel", "left"), F.when(bad, F.col("med")).otherwise(v))
    if action == "local_median":
        b, a = centered(max(3, local_median_window))
        r = rolling(m, KEY, "t", lambda w: {"_m": F.percentile("value", F.lit(0.5)).over(w.rowsBetween(-b, a))}, b, a)
        return _put(r, F.when(bad, F.col("_m")).otherwise(v))
    if action in ("clip", "winsorize"):
        q = quantiles(df, KEY, "value", {"lo": p_low / 100, "hi": p_high / 100})
        clipped = F.least(F.greatest(v, F.col("lo")), F.col("hi"))
        return _put(m.join(q, "channel", "left"), F.when(bad, clipped).otherwise(v))
    raise ValueError(f"unknown outlier action {action!r}")


def clip_robust(df: DataFrame, z: float = 5.0) -> DataFrame:
    """Clip to median +- z scaled deviations."""
    s = median_mad(df, KEY, "value")
    half = z * (F.col("mad") * MAD_SCALE + TINY)
    v = F.col("value")
    c = F.least(F.greatest(v, F.col("med") - half), F.col("med") + half)
    return _put(df.join(s, "channel", "left"), F.when(v.isNotNull(), c))


def replace_spikes(df: DataFrame, z: float = 5.0, window: int = 5) -> DataFrame:
    """Points whose step exceeds z times the step deviation become the local median."""
    d = _abs_diff(df)
    s = median_mad(d, KEY, "_d").select("channel", "mad")
    b, a = centered(window)
    r = rolling(d, KEY, "t", lambda w: {"_m": F.percentile("value", F.lit(0.5)).over(w.rowsBetween(-b, a))}, b, a)
    hit = F.coalesce(F.col("_d") / (F.col("mad") * MAD_SCALE + TINY) > z, F.lit(False))
    return _put(r.join(s, "channel", "left"), F.when(hit, F.col("_m")).otherwise(F.col("value")))


# -- normalisation and trends -----------------------------------------------------------


def zscore(df: DataFrame, ddof: int = 0) -> DataFrame:
    sd = F.stddev_pop("value") if ddof == 0 else F.stddev_samp("value")
    s = _stats(df, m=F.avg("value"), s=sd)
    scale = F.when(F.col("s") > TINY, F.col("s")).otherwise(F.lit(1.0))
    return _put(df.join(s, "channel"), (F.col("value") - F.col("m")) / scale)


def robust_zscore(df: DataFrame) -> DataFrame:
    s = median_mad(df, KEY, "value")
    return _put(
        df.join(s, "channel", "left"), (F.col("value") - F.col("med")) / (F.col("mad") * MAD_SCALE + TINY)
    )


def minmax(df: DataFrame) -> DataFrame:
    s = _stats(df, lo=F.min("value"), hi=F.max("value"))
    span = F.when(F.col("hi") - F.col("lo") > TINY, F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    return _put(df.join(s, "channel"), (F.col("value") - F.col("lo")) / span)


def rank_normalize(df: DataFrame, mode: str = "rank", ties: str = "average") -> DataFrame:
    """Ranks from 1, or ``pct``: (r-1)/max(1, rmax-1)."""
    r = rank_column(df, KEY, "value", ties)
    if mode != "pct":
        return _put(r, F.col("rank"))
    top = r.groupBy("channel").agg(F.max("rank").alias("top"))
    return _put(r.join(top, "channel"), (F.col("rank") - 1) / F.greatest(F.lit(1.0), F.col("top") - 1))


NORMALIZERS = {
    "zscore": zscore,
    "robust_z": robust_zscore,
    "minmax": minmax,
    "rank": lambda df: rank_normalize(df, "rank"),
    "rank_dense": lambda df: rank_normalize(df, "rank", "dense"),
    "rank_pct": lambda df: rank_normalize(df, "pct"),
}


def normalize(df: DataFrame, mode: str) -> DataFrame:
    if mode in ("none", "", None):
        return df
    if mode not in NORMALIZERS:
        raise ValueError(f"unknown normalisation {mode!r}")
    return NORMALIZERS[mode](df)


def detrend_linear(df: DataFrame) -> DataFrame:
    """Residual of an OLS line over position (three points at least)."""
    t = F.col("t").cast("double")
    s = df.filter("value IS NOT NULL").groupBy("channel").agg(
        F.count("value").alias("n"),
        F.avg(t).alias("mt"),
        F.avg("value").alias("mv"),
        F.try_divide(F.covar_pop("value", t), F.var_pop(t)).alias("b"),
    )
    fit = F.col("value") - F.col("mv") - F.col("b") * (t - F.col("mt"))
    return _put(df.join(s, "channel", "left"), F.when(F.col("n") >= 3, fit).otherwise(F.col("value")))


def highpass(df: DataFrame, window: int = 50) -> DataFrame:
    b, a = centered(window)
    r = rolling(df, KEY, "t", lambda w: {"_m": F.avg("value").over(w.rowsBetween(-b, a))}, b, a)
    return _put(r, F.col("value") - F.col("_m"))


def rolling_median(df: DataFrame, window: int = 5) -> DataFrame:
    b, a = centered(window)
    r = rolling(df, KEY, "t", lambda w: {"_m": F.percentile("value", F.lit(0.5)).over(w.rowsBetween(-b, a))}, b, a)
    return _put(r, F.col("_m"))


# -- prewhitening -----------------------------------------------------------------------


def _lagged(df: DataFrame) -> DataFrame:
    return rolling(df, KEY, "t", lambda w: {"_l": F.lag("value").over(w)}, before=1)


def prewhiten_ar1(df: DataFrame) -> DataFrame:
    """Remove x[t-1]*phi with phi from least squares without intercept; first value 0."""
    d = _lagged(df)
    l, v = F.col("_l"), F.col("value")
    s = _stats(d, phi=F.try_divide(F.sum(l * v), F.sum(F.when(v.isNotNull(), l * l))))
    r = F.when(F.col("t") == 0, F.lit(0.0)).otherwise(v - F.coalesce("phi", F.lit(0.0)) * l)
    return _put(d.join(s, "channel"), r)


def remove_ar1(df: DataFrame) -> DataFrame:
    """Variant with phi = lag-1 correlation, used only if above .01; first value kept."""
    d = _lagged(df)
    l, v = F.col("_l"), F.col("value")
    both = l.isNotNull() & v.isNotNull()
    phi = F.try_divide(
        F.covar_pop(l, v), F.sqrt(F.var_pop(F.when(both, l)) * F.var_pop(F.when(both, v)))
    )
    s = _stats(d, phi=phi)
    use = (F.abs("phi") > 0.01) & (F.col("t") > 0)
    return _put(d.join(s, "channel"), F.when(use, v - F.col("phi") * l).otherwise(v))
