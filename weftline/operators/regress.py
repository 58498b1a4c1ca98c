"""Tests and filters built on lagged regressions.

Regressions on a series' own past need only its lagged products and the values at its two
ends, so a channel of any length is reduced to a few dozen numbers before anything is solved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.blocks import BLOCK, positions, rolling
from weftline.functions.special import chi2_sf, f_sf, norm_cdf
from weftline.operators.moments import gram, gram_sets, residualize, solve_ols
from weftline.operators.spectral import autocorrelation, closed_up, lengths_of
from weftline.panel import Panel
from weftline.session import spread, staged

PAIR = ["src", "dst"]


# -- lag profiles ---------------------------------------------------------------------------


def lag_profile(closed: DataFrame, reach: int, centre: bool = True, size: int = BLOCK) -> DataFrame:
    """``channel, kind, i, v``: lagged products (kind s), first and last values (h, t), n and mean.

    Each block of consecutive positions sees ``reach`` values of the next one; its products are
    summed per lag, so a channel ends as about 3 * reach rows.
    """
    stats = closed.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    z = F.col("value") - F.col("m") if centre else F.col("value")
    d = closed.join(stats, "channel").select("channel", "n", "pos", z.alias("z"))
    size = max(size, reach)
    blk = F.floor(F.col("pos") / size)
    near = F.pmod(F.col("pos"), F.lit(size)) < reach
    near_rows = d.select(
        "*", F.explode(F.array_compact(F.array(blk, F.when(near & (blk > 0), blk - 1)))).alias("b")
    )

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        z = pdf["z"].to_numpy()
        own = int((pdf["pos"].to_numpy() // size == pdf["b"].iloc[0]).sum())
        s = [float(z[: min(own, len(z) - k)] @ z[k : k + min(own, len(z) - k)]) if k < len(z) else 0.0 for k in range(reach + 1)]
        return pd.DataFrame({"channel": pdf["channel"].iloc[0], "kind": "s", "i": np.arange(reach + 1), "v": s})

    schema = "channel string, kind string, i bigint, v double"
    sums = spread(near_rows, "channel", "b").groupBy("channel", "b").applyInPandas(products, schema)
    sums = sums.groupBy("channel", "kind", "i").agg(F.sum("v").alias("v"))
    head = d.filter(F.col("pos") < reach).select("channel", F.lit("h").alias("kind"), F.col("pos").alias("i"), F.col("z").alias("v"))
    tail = d.filter(F.col("pos") >= F.col("n") - reach).select(
        "channel", F.lit("t").alias("kind"), (F.col("n") - 1 - F.col("pos")).alias("i"), F.col("z").alias("v")
    )
    size_row = stats.select("channel", F.lit("n").alias("kind"), F.lit(0).cast("bigint").alias("i"), F.col("n").cast("double").alias("v"))
    mean_row = stats.select("channel", F.lit("m").alias("kind"), F.lit(0).cast("bigint").alias("i"), F.col("m").alias("v"))
    return sums.unionByName(head).unionByName(tail).unionByName(size_row).unionByName(mean_row)


class Profile:
    """Lag sums of one channel inside a task."""

    def __init__(self, pdf: pd.DataFrame, centred: bool = True):
        part = {k: g.sort_values("i")["v"].to_numpy() for k, g in pdf.groupby("kind")}
        self.n, self.mean = int(part["n"][0]), float(part["m"][0])
        self.s, self.head, self.tail = part["s"], part.get("h", np.zeros(0)), part.get("t", np.zeros(0))
        self.total = 0.0 if centred else self.n * self.mean

    def gram(self, start: int, order: int) -> np.ndarray:
        """Cross products of [1, z_t, z_{t-1}, ..., z_{t-order}] over t = start .. n-1."""
        k = order + 1
        g = np.zeros((k + 1, k + 1))
        g[0, 0] = self.n - start
        before = np.concatenate([[0.0], np.cumsum(self.head)])
        after = np.concatenate([[0.0], np.cumsum(self.tail)])
        last = self.tail[::-1]  # ascending positions n-len .. n-1
        for i in range(k):
            g[0, i + 1] = g[i + 1, 0] = self.total - before[start - i] - after[i]
            for j in range(i, k):
                d = j - i
                lo = float(self.head[: start - j] @ self.head[d : start - j + d])
                cut = last[len(last) - j :] if j else last[:0]
                hi = float(cut[: len(cut) - d] @ cut[d:]) if len(cut) > d else 0.0
                g[i + 1, j + 1] = g[j + 1, i + 1] = self.s[d] - lo - hi
        return g


def per_channel(profile: DataFrame, fn: Callable[[Profile], dict], schema: str, centred: bool = True) -> DataFrame:
    """Apply ``fn`` to each channel's profile (a bounded number of rows)."""
    names = [p.split()[0] for p in schema.split(", ")]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"channel": pdf["channel"].iloc[0], **fn(Profile(pdf, centred))}
        return pd.DataFrame([[out.get(c) for c in ["channel", *names]]], columns=["channel", *names])

    return profile.groupBy("channel").applyInPandas(kernel, f"channel string, {schema}")


# -- unit root ------------------------------------------------------------------------------

# Published response surface of the unit-root statistic (constant, one series).
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(stat: float) -> float:
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    c = TAU_SMALL if stat <= TAU_STAR else TAU_LARGE
    return norm_cdf(sum(a * stat**i for i, a in enumerate(c)))


def default_adf_lag(n: int) -> int:
    return max(0, min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25)))


def _adf_fit(p: Profile, start: int, lags: int) -> tuple[int, float, float]:
    """Rows, residual sum and t-value of the level in diff ~ 1 + level + lagged diffs."""
    g = p.gram(start, lags + 1)
    k = lags + 3
    a = np.zeros((k, lags + 3))  # response, 1, level, differences in terms of 1, z_t, z_{t-1}, ...
    a[0, 1], a[0, 2] = 1, -1
    a[1, 0] = 1
    a[2, 2] = 1
    for j in range(1, lags + 1):
        a[2 + j, 1 + j], a[2 + j, 2 + j] = 1, -1
    m = a @ g @ a.T
    xx, xy, yy = m[1:, 1:], m[1:, 0], m[0, 0]
    inv = np.linalg.pinv(xx)
    beta = inv @ xy
    rows = p.n - start
    rss = float(yy - beta @ xy)
    df = rows - (lags + 2)
    se = math.sqrt(max(rss, 0.0) / df * inv[1, 1]) if df > 0 and inv[1, 1] > 0 else float("nan")
    return rows, rss, float(beta[1] / se) if se > 0 else float("nan")


def adf_of(p: Profile, max_lag: int | None = None, search: bool = True) -> dict:
    if p.n < 5 or p.s[0] <= 0:
        return {}
    top = default_adf_lag(p.n) if max_lag is None else min(max_lag, p.n // 2 - 2)
    best = top
    if search:
        scores = []
        for lag in range(top + 1):
            rows, rss, _ = _adf_fit(p, top + 1, lag)
            scores.append((rows * math.log(max(rss, 1e-300) / rows) + 2 * (lag + 2), lag))
        best = min(scores)[1]
    rows, _, stat = _adf_fit(p, best + 1, best)
    if not math.isfinite(stat):
        return {}
    return {"stat": stat, "pvalue": unit_root_p(stat), "used_lag": best, "nobs": rows}


def adf(long: DataFrame, max_lag: int | None = None, search: bool = True) -> DataFrame:
    """Augmented Dickey-Fuller test per channel (constant, lag by AIC): ``stat, pvalue, used_lag, nobs``."""
    closed = staged(closed_up(long))
    lengths = lengths_of(closed)
    reach = max([default_adf_lag(n) if max_lag is None else max_lag for n in lengths.values()] or [0]) + 3
    return per_channel(
        lag_profile(closed, reach), lambda p: adf_of(p, max_lag, search), "stat double, pvalue double, used_lag double, nobs double"
    )


# -- autocorrelation tests --------------------------------------------------------------------


def ljung_box_of(p: Profile, lags: int) -> tuple[float, float]:
    rho = p.s[1 : lags + 1] / p.s[0]
    q = float(p.n * (p.n + 2) * np.sum(rho**2 / (p.n - np.arange(1, lags + 1))))
    return q, chi2_sf(q, lags)


def ljung_box(long: DataFrame, lags: int | None = None) -> DataFrame:
    """``channel, lb_lags, lb_q, lb_p``; default lags max(1, min(n//5, 20)), NULL for short series."""

    def fn(p: Profile) -> dict:
        h = lags or max(1, min(p.n // 5, 20))
        if p.n < max(12, 3 * h) or p.s[0] <= 0:
            return {"lb_lags": float(h)}
        q, pv = ljung_box_of(p, h)
        return {"lb_lags": float(h), "lb_q": q, "lb_p": pv}

    return per_channel(lag_profile(staged(closed_up(long)), (lags or 20) + 1), fn, "lb_lags double, lb_q double, lb_p double")


def autocorr_summary(long: DataFrame, max_lag: int | None = None) -> DataFrame:
    """``rho1, phi_ar1, tau_int, n_eff, lb_p, lb_lags`` per channel."""
    closed = staged(closed_up(long))
    pair = rolling(closed, ["channel"], "pos", lambda w: {"b": F.lead("value").over(w)}, after=1)
    a, b = F.col("value"), F.col("b")
    past = F.when(b.isNotNull(), a)
    sa, sb = F.stddev_pop(past), F.stddev_pop("b")
    m = pair.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"),
        (F.covar_pop("value", "b") / F.when(sa * sb > 1e-12, sa * sb)).alias("rho1"),
        F.try_divide(F.sum(a * b), F.when(F.sum(past * past) > 1e-12, F.sum(past * past))).alias("phi_ar1"),
    )
    acfs = autocorrelation(closed, lengths_of(closed))
    reach = F.lit(max_lag) if max_lag is not None else F.greatest(F.lit(10), F.floor(F.col("n") / 4))
    inside = (F.col("lag") >= 1) & (F.col("lag") <= F.least(F.col("n") - 1, reach)) & (F.col("acf") > 0)
    tau = acfs.groupBy("channel").agg(
        F.greatest(F.lit(1.0), 1 + 2 * F.coalesce(F.sum(F.when(inside, F.col("acf"))), F.lit(0.0))).alias("tau_int")
    )
    out = m.join(tau, "channel", "left").join(ljung_box(long), "channel", "left")
    return out.select(
        "channel", "rho1", "phi_ar1", "tau_int", F.greatest(F.lit(1.0), F.col("n") / F.col("tau_int")).alias("n_eff"), "lb_p", "lb_lags"
    )


# -- autoregressive prewhitening -----------------------------------------------------------------


def ar_coefficients(long: DataFrame, order: int) -> DataFrame:
    """Least squares of x_t on its last ``order`` values without intercept: ``channel, coef``."""

    def fn(p: Profile) -> dict:
        if p.n <= 2 * order:
            return {"coef": [0.0] * order}
        g = p.gram(order, order)[1:, 1:]
        return {"coef": np.linalg.lstsq(g[1:, 1:], g[1:, 0], rcond=None)[0].tolist()}

    return per_channel(lag_profile(staged(closed_up(long)), order + 1, centre=False), fn, "coef array<double>", centred=False)


def prewhiten(long: DataFrame, order: int = 1) -> DataFrame:
    """Residuals of an AR(order) fit per channel; the first ``order`` values become 0.

    Expects filled channels, as the cleaning chain delivers them.
    """

    def past(w):
        return {f"_l{k}": F.lag("value", k).over(w) for k in range(1, order + 1)}

    d = rolling(long, ["channel"], "t", past, before=order).join(ar_coefficients(long, order), "channel", "left")
    fit = F.col("coef")[0] * F.col("_l1")
    for k in range(2, order + 1):
        fit = fit + F.col("coef")[k - 1] * F.col(f"_l{k}")
    return d.select("t", "channel", F.when(F.col("t") < order, F.lit(0.0)).otherwise(F.col("value") - fit).alias("value"))


def ar_diagnostics(long: DataFrame, order: int = 1) -> DataFrame:
    """Per channel before and after prewhitening: phi1, correlation at lags 1 and order, portmanteau p."""

    def fn(p: Profile) -> dict:
        if p.n < 8:
            return {}
        raw = p.gram(1, 1)
        n1 = raw[0, 0]
        shift = p.mean
        xy = raw[1, 2] + shift * (raw[0, 1] + raw[0, 2]) + n1 * shift * shift
        xx = raw[2, 2] + 2 * shift * raw[0, 2] + n1 * shift * shift
        out = {"phi1": xy / xx if xx > 0 else None}
        for name, k in (("r1", 1), ("rp", order)):
            g = p.gram(k, k)
            n = g[0, 0]
            if n < 5:
                continue
            c = g[1, k + 1] - g[0, 1] * g[0, k + 1] / n
            v = (g[1, 1] - g[0, 1] ** 2 / n) * (g[k + 1, k + 1] - g[0, k + 1] ** 2 / n)
            out[name] = c / math.sqrt(v) if v > 0 else None
        h = max(1, min(p.n // 5, 20))
        if p.n >= max(12, 3 * h) and p.s[0] > 0:
            out["lb_p"] = ljung_box_of(p, h)[1]
        return out

    reach = max(21, order + 1)
    cols = ("phi1", "r1", "rp", "lb_p")

    def table(df: DataFrame, suffix: str) -> DataFrame:
        t = per_channel(lag_profile(staged(closed_up(df)), reach), fn, "phi1 double, r1 double, rp double, lb_p double")
        return t.select("channel", *[F.col(c).alias(f"{c}_{suffix}") for c in cols])

    return table(long, "before").join(table(prewhiten(long, order), "after"), "channel", "full")


def ar_summary(diagnostics: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: quartiles of each measure over channels, share of significant tests, mean |r1| reduction."""
    cols = [c for c in diagnostics.columns if c != "channel"]
    q = [
        F.percentile(c, F.lit(p)).alias(f"{c}_q{int(p * 100)}") for c in cols if not c.startswith("lb") for p in (0.25, 0.5, 0.75)
    ]
    share = [F.avg((F.col(c) < alpha).cast("double")).alias(f"{c}_frac") for c in cols if c.startswith("lb")]
    drop = F.avg(F.abs("r1_before") - F.abs("r1_after")).alias("r1_reduction")
    return diagnostics.agg(F.count(F.lit(1)).alias("channels"), *q, *share, drop)


# -- Granger causality -----------------------------------------------------------------------------


def granger_tests(points: DataFrame, lag: int = 5, keys: Sequence[str] = PAIR) -> DataFrame:
    """F test of x -> y for every order 1..lag: ``keys, order, n, f, p``.

    Lagged products are one grouped aggregate; the small systems are solved where the
    aggregated rows are.
    """
    keys = list(keys)
    lag = max(1, int(lag))
    pts = points.select(*keys, "t", "x", "y")
    pos = positions(pts, keys, "t", "pos", rows=pts).drop("t")

    def past(w):
        return {f"{c}{k}": F.lag(c, k).over(w) for c in ("x", "y") for k in range(1, lag + 1)}

    d = rolling(pos, keys, "pos", past, before=lag)
    names = ["y", *[f"y{k}" for k in range(1, lag + 1)], *[f"x{k}" for k in range(1, lag + 1)]]
    orders = F.explode(F.sequence(F.lit(1), F.lit(lag))).alias("order")
    flat = d.select(*keys, "pos", *names, orders).filter(F.col("pos") >= F.col("order"))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            need = max(int(a[1:] or 0), int(b[1:] or 0))
            keep = F.when(F.col("order") >= need, F.col(a)) if need else F.col(a)
            aggs.append(F.covar_pop(keep, F.col(b)).alias(f"c{i}_{j}"))
    moments = flat.groupBy(*keys, "order").agg(*aggs)
    kt = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pts.schema if f.name in keys)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                o, n = int(r["order"]), int(r["n"])
                idx = [0, *range(1, o + 1), *range(lag + 1, lag + 1 + o)]
                g = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in idx] for i in idx], dtype=float) * n
                yy, own, full = g[0, 0], list(range(1, o + 1)), list(range(1, 2 * o + 1))

                def rss(cols, g=g, yy=yy):
                    b = np.linalg.lstsq(g[np.ix_(cols, cols)], g[cols, 0], rcond=None)[0]
                    return max(float(yy - b @ g[cols, 0]), 0.0)

                df = n - (2 * o + 1)
                ru = rss(full) if np.isfinite(g).all() and df > 0 else 0.0
                if ru > 0:
                    f = (rss(own) - ru) / ru / o * df
                    rows.append((*[r[k] for k in keys], o, n, f, f_sf(f, o, df)))
                else:
                    rows.append((*[r[k] for k in keys], o, n, None, None))
            yield pd.DataFrame(rows, columns=[*keys, "order", "n", "f", "p"])

    return moments.mapInPandas(solve, f"{kt}, order int, n bigint, f double, p double")


def granger_points(points: DataFrame, lag: int = 5, keys: Sequence[str] = PAIR) -> DataFrame:
    """Smallest p over orders 1..lag times lag (at most 1); 1 for short or degenerate pairs."""
    keys = list(keys)
    size = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    t = granger_tests(points, lag, keys).groupBy(*keys).agg(F.min("p").alias("p"), F.count("p").alias("k"))
    ok = (F.col("total") > 2 * lag + 5) & (F.col("k") == lag)
    value = F.when(ok, F.least(F.lit(1.0), F.col("p") * lag)).otherwise(F.lit(1.0))
    return size.join(t, keys, "left").select(*keys, value.alias("value"))


def granger_full(panel: Panel, lag: int = 5, pairs=None) -> DataFrame:
    return granger_points(panel.pair_points(True, pairs), lag)


def granger_partial(panel: Panel, lag: int = 5, control: Sequence[str] | None = None, pairs=None, extra=None) -> DataFrame:
    """Wald F test in a vector autoregression of all channels (or of the pair and its controls).

    One aggregate over the rows complete in every channel used holds all lagged products; each
    system is a block of it.  A system with too few rows for its coefficients has no value.
    """
    if extra:
        return granger_full(residualize(panel, (), extra), lag, pairs)
    p, todo = max(1, int(lag)), panel.pair_list(True, pairs)
    held = list(panel.channels) if control is None else [c for c in control if c in panel.channels]
    chans = list(dict.fromkeys([*held, *[c for pair in todo for c in pair]]))
    n, means, g = _lagged_gram(panel, chans, p)
    m, at = len(chans), {c: i for i, c in enumerate(chans)}

    def block(names: list[str]):
        own = [m + k * m + at[c] for k in range(p) for c in names]
        return own, np.linalg.pinv(g[np.ix_(own, own)])

    whole = block(chans) if control is None else None
    out = []
    for a, b in todo:
        names = chans if control is None else [b, a, *[c for c in held if c not in (a, b)]]
        df = n - (p * len(names) + 1)
        if df <= 0:
            out.append((a, b, None))
            continue
        own, inv = whole or block(names)
        _, beta, rss = solve_ols(n, means, g, at[b], own)
        mine = [k * len(names) + names.index(a) for k in range(p)]
        cov = inv[np.ix_(mine, mine)] * rss / df
        f = float(beta[mine] @ np.linalg.pinv(cov) @ beta[mine]) / p
        out.append((a, b, float(f_sf(f, p, len(names) * df))))
    return panel.frame.sparkSession.createDataFrame(out, "src string, dst string, value double")


def _lagged_gram(panel: Panel, chans: list[str], p: int):
    """Count, means and centred products of the channels and their lags 1..p over complete rows."""
    cols = [f"`{c}`" for c in chans]
    full = panel.frame.select("t", *[F.col(c) for c in cols]).dropna(how="any", subset=cols)
    pos = positions(full, [], "t", "pos", rows=full.select("t")).drop("t")

    def past(w):
        return {f"{c}~{k}": F.lag(F.col(f"`{c}`"), k).over(w) for k in range(1, p + 1) for c in chans}

    d = rolling(pos, [], "pos", past, before=p)
    return gram(d, [*[F.col(c) for c in cols], *[F.col(f"`{c}~{k}`") for k in range(1, p + 1) for c in chans]])


# -- regression fit ---------------------------------------------------------------------------------


def r_squared(panel: Panel, target: str, controls: Sequence[str]) -> DataFrame:
    """``target, controls, r2`` of the linear regression over complete rows."""
    n, means, g = gram_sets(panel.frame, [panel.col(c) for c in (target, *controls)], [range(len(controls) + 1)])[0]
    _, _, rss = solve_ols(n, means, g, 0, range(1, len(controls) + 1))
    r2 = float(1 - rss / g[0, 0]) if n and g[0, 0] > 0 else None
    return panel.frame.sparkSession.createDataFrame(
        [(target, ",".join(controls), r2)], "target string, controls string, r2 double"
    )
