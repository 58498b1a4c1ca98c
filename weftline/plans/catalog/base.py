"""Registration and the panels the catalog queries run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.panel import Panel
from weftline.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# the channels that the SQL of these panels names
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def r6(c, digits: int = 6):
    """Round for comparison; adding zero removes the sign of a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # hour, six-hour, day and month numbers come from the calendar fields, so no time zone enters
    def _hours(self, c: str):
        return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) * 24 + F.hour(c)

    def ev_mean(self, step: int = 1) -> Panel:
        """Mean event value per hour (or per ``step`` hours) and event type; hours without events are absent."""
        return Panel.from_buckets(
            self.read("events"), F.floor(self._hours("ts") / step), "event_type", "mean", "value"
        )

    def ev_count(self) -> Panel:
        return Panel.from_buckets(self.read("events"), self._hours("ts"), "event_type", "count", None)

    def od_month(self) -> Panel:
        month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
        return Panel.from_buckets(self.read("orders"), month, "o_orderpriority", "sum", "o_totalprice")

    def od_day(self) -> Panel:
        day = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date"))
        return Panel.from_buckets(self.read("orders"), day, "o_orderpriority", "sum", "o_totalprice")

    def embedding_panel(self) -> Panel:
        """Vector id as position, dimension as channel (one narrow projection)."""
        e = self.read("embeddings")
        size = e.agg(F.max(F.size("embedding"))).first()[0] or 0
        cols = [F.get("embedding", F.lit(i)).cast("double").alias(f"d{i:02d}") for i in range(size)]
        return Panel.from_wide(e.select(F.col("vec_id").alias("t"), *cols))


def panel_sql(name: str) -> str:
    """``WITH p(t, channels...), pl(t, channel, value)`` for one of the panels above."""

    def q(c: str) -> str:
        return '"' + c + '"'

    if name.startswith("ev"):
        chans, table, key = EVENT_TYPES, "events", "event_type"
        hours = "(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 24 + hour(ts))"
        if name == "ev_count":
            bucket, agg = hours, "CAST(count(*) FILTER ({k} = '{c}') AS DOUBLE)"
        else:
            step = int(name[len("ev_mean"):] or 1)
            bucket, agg = f"{hours} // {step}", "avg(value) FILTER ({k} = '{c}')"
    else:
        chans, table, key = PRIORITIES, "orders", "o_orderpriority"
        agg = "sum(o_totalprice) FILTER ({k} = '{c}')"
        if name == "od_month":
            bucket = "year(o_orderdate) * 12 + month(o_orderdate)"
        else:
            bucket = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"
    cells = ", ".join(agg.format(k=key, c=c) + " AS " + q(c) for c in chans)
    cols = ", ".join(q(c) for c in chans)
    longs = " UNION ALL ".join(f"SELECT t, '{c}' AS channel, {q(c)} AS value FROM p" for c in chans)
    return (
        f"WITH binned AS (SELECT {bucket} AS b, {cells} FROM {table} GROUP BY 1), "
        f"p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY b) - 1 AS t, {cols} FROM binned), "
        f"pl AS MATERIALIZED ({longs})"
    )


def channels_of(name: str) -> tuple[str, ...]:
    return EVENT_TYPES if name.startswith("ev") else PRIORITIES


def points_sql(name: str, directed: bool, lag: int = 0) -> str:
    """Adds ``pt(src, dst, t, x, y)``: pairwise-complete points, y taken ``lag`` ahead."""
    order = "a.channel <> b.channel" if directed else "a.channel < b.channel"
    return (
        panel_sql(name)
        + f", pt AS MATERIALIZED (SELECT a.channel AS src, b.channel AS dst, a.t, a.value AS x, b.value AS y "
        f"FROM pl a JOIN pl b ON b.t = a.t + {lag} AND {order} "
        "WHERE a.value IS NOT NULL AND b.value IS NOT NULL)"
    )


def filled_sql(name: str) -> str:
    """Panel with mean-filled cells: ``p`` and ``pl`` are shadowed by the filled versions."""
    chans = channels_of(name)
    cells = ", ".join(f'coalesce("{c}", avg("{c}") OVER ()) AS "{c}"' for c in chans)
    longs = " UNION ALL ".join(f"SELECT t, '{c}' AS channel, \"{c}\" AS value FROM pf" for c in chans)
    return panel_sql(name) + f", pf AS MATERIALIZED (SELECT t, {cells} FROM p), plf AS MATERIALIZED ({longs})"


def eliminated(source: str, count: int, name: str = "pt", by: str = "src, dst") -> str:
    """CTEs that take ``z0`` .. of ``source(src, dst, t, x, y, z...)`` out of x and y one after the other, within each pair (or ``by``)."""
    parts, last = [], source
    for k in range(count):
        rest = [c for c in ("x", "y", *(f"z{i}" for i in range(k + 1, count)))]
        cells = ", ".join(f"{c} - avg({c}) OVER w - regr_slope({c}, z{k}) OVER w * (z{k} - avg(z{k}) OVER w) AS {c}" for c in rest)
        here = name if k == count - 1 else f"{source}_{k}"
        parts.append(f"{here} AS MATERIALIZED (SELECT {by}, t, {cells} FROM {last} WINDOW w AS (PARTITION BY {by}))")
        last = here
    return ", ".join(parts)


def with_controls_sql(name: str, directed: bool, table: str = "p", ahead: int = 0) -> str:
    """CTE ``pz(src, dst, t, x, y, z...)``: complete rows of every pair with all other channels as controls."""
    chans = channels_of(name)
    cond = " AND ".join(f'a."{c}" IS NOT NULL' for c in chans)
    parts = []
    for i, s in enumerate(chans):
        for j, d in enumerate(chans):
            if i == j or (not directed and i > j):
                continue
            zs = ", ".join(f'a."{z}" AS z{k}' for k, z in enumerate(c for c in chans if c not in (s, d)))
            parts.append(f"SELECT '{s}' AS src, '{d}' AS dst, a.t, a.\"{s}\" AS x, b.\"{d}\" AS y, {zs} FROM {table} a JOIN {table} b ON b.t = a.t + {ahead} WHERE {cond}")
    return f"pz AS MATERIALIZED ({' UNION ALL '.join(parts)})"


def residual_sql(name: str, directed: bool) -> str:
    """``pt`` of every pair's residuals on all other channels, over rows complete in all of them."""
    return panel_sql(name) + ", " + with_controls_sql(name, directed) + ", " + eliminated("pz", len(channels_of(name)) - 2)


# points that differ by rounding alone are one point
ROUNDED = ", pt AS MATERIALIZED (SELECT src, dst, t, round(x, 10) AS x, round(y, 10) AS y FROM exact)"


def ahead_residual_sql(name: str) -> str:
    """``pt`` of residuals on all other channels of mean-filled series, y one step ahead of x and the controls."""
    return filled_sql(name) + ", " + with_controls_sql(name, False, "pf", 1) + ", " + eliminated("pz", len(channels_of(name)) - 2, "exact") + ROUNDED


def controlled_points_sql(name: str, control: str) -> str:
    """``pt`` of residuals on one channel, over rows complete in a channel and the control."""
    res = " UNION ALL ".join(
        f"SELECT t, '{c}' AS channel, \"{c}\" - (avg(\"{c}\") OVER () + regr_slope(\"{c}\", \"{control}\") OVER () * (\"{control}\" - avg(\"{control}\") OVER ())) AS value "
        f"FROM p WHERE \"{c}\" IS NOT NULL AND \"{control}\" IS NOT NULL"
        for c in channels_of(name) if c != control
    )
    return panel_sql(name) + f", r AS MATERIALIZED ({res}), pt AS MATERIALIZED (SELECT a.channel AS src, b.channel AS dst, a.t, a.value AS x, b.value AS y FROM r a JOIN r b ON a.t = b.t AND a.channel < b.channel)"


def all_pairs_sql(name: str, directed: bool) -> str:
    """A list of the channels' pairs, for pairs that are told also where they have no value."""
    chans = channels_of(name)
    pairs = [(a, b) for i, a in enumerate(chans) for j, b in enumerate(chans) if (i != j if directed else i < j)]
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ") AS ap(src, dst)"
