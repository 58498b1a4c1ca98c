"""The panel: a time-ordered matrix of channels as a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.blocks import BLOCK, positions, rolling
from weftline.session import staged

MAX_CHANNEL_COLUMNS = 10_000
MANY_CHANNELS = 150  # above this, pairs are made by explodes instead of a constant list


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, the only missing marker inside the engine."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def clamped(c: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (least and greatest would skip it)."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def channel_names(df: DataFrame, column: str) -> list[str]:
    """Distinct channel names of a long table; channels become columns, so they are few."""
    rows = df.select(column).distinct().orderBy(column).limit(MAX_CHANNEL_COLUMNS + 1).collect()
    if len(rows) > MAX_CHANNEL_COLUMNS:
        raise ValueError(f"more than {MAX_CHANNEL_COLUMNS} channels in {column}: reduce channels first")
    return [r[0] for r in rows if r[0] is not None]


@dataclass(frozen=True)
class Panel:
    """``frame`` has column ``t`` (dense 0-based position) and one double column per channel."""

    frame: DataFrame
    channels: tuple[str, ...]
    block: int = BLOCK
    complete: bool = False  # no missing cell and no missing position: gap handling can be skipped

    # -- construction ---------------------------------------------------------------
    @classmethod
    def from_wide(cls, df: DataFrame, channels: Sequence[str] | None = None, block: int = BLOCK) -> Panel:
        names = tuple(channels) if channels is not None else tuple(c for c in df.columns if c != "t")
        cols = [finite(F.col(f"`{c}`")).alias(c) for c in names]
        return cls(df.select(F.col("t").cast("bigint").alias("t"), *cols), names, block)

    @classmethod
    def from_long(
        cls, df: DataFrame, channels: Sequence[str] | None = None, block: int = BLOCK, complete: bool = False
    ) -> Panel:
        """Pivot ``t, channel, value``; absent cells become NULL."""
        names = tuple(channels) if channels is not None else tuple(channel_names(df, "channel"))
        aggs = [F.max(F.when(F.col("channel") == c, finite(F.col("value")))).alias(c) for c in names]
        return cls(df.groupBy(F.col("t").cast("bigint").alias("t")).agg(*aggs), names, block, complete)

    @classmethod
    def from_buckets(
        cls,
        df: DataFrame,
        bucket: Column,
        channel: str,
        aggregate: str,
        value: str | None,
        channels: Sequence[str] | None = None,
        block: int = BLOCK,
    ) -> Panel:
        """Aggregate an event table to (integer time bucket x channel), then number the buckets.

        One map-side-combined shuffle on the bucket; hot channels are only a wider
        column, never a bigger group.  ``aggregate`` is mean, sum or count.
        """
        names = tuple(channels) if channels is not None else tuple(channel_names(df, channel))

        def cell(c: str) -> Column:
            hit = F.col(channel) == c
            if aggregate == "count":
                return F.count(F.when(hit, F.lit(1))).cast("double")
            v = F.when(hit, finite(F.col(value)))
            return F.avg(v) if aggregate == "mean" else F.sum(v)

        # the panel is far smaller than its source and every metric reads it many times, so it is
        # written once; the source is scanned a single time
        binned = df.groupBy(bucket.cast("bigint").alias("_bucket")).agg(*[cell(c).alias(c) for c in names])
        numbered = positions(staged(binned), [], "_bucket", out="t", size=1024).drop("_bucket")
        frame = numbered.select("t", *[F.col(f"`{c}`") for c in names])
        return cls(staged(frame), names, block, complete=aggregate == "count")

    # -- shapes -----------------------------------------------------------------------
    def with_frame(self, frame: DataFrame, channels: Sequence[str] | None = None) -> Panel:
        """Same panel with other content; says nothing about missing cells any more."""
        names = tuple(channels) if channels is not None else self.channels
        return replace(self, frame=frame, channels=names, complete=False)

    def col(self, c: str) -> Column:
        return F.col(f"`{c}`")

    def select(self, channels: Sequence[str]) -> Panel:
        kept = self.frame.select("t", *[self.col(c) for c in channels])
        return replace(self, frame=kept, channels=tuple(channels))

    def map_columns(self, fn) -> Panel:
        return self.with_frame(self.frame.select("t", *[fn(self.col(c)).alias(c) for c in self.channels]))

    def length(self) -> int:
        """Number of positions (one small aggregate)."""
        last = self.frame.agg(F.max("t")).first()[0]
        return 0 if last is None else int(last) + 1

    def long(self) -> DataFrame:
        """``t, channel, value`` with NULL cells kept (a narrow operation)."""
        cells = F.posexplode(F.array(*[self.col(c) for c in self.channels])).alias("k", "value")
        names = F.from_json(F.lit(json.dumps(list(self.channels))), "array<string>")
        return self.frame.select("t", cells).select("t", F.get(names, F.col("k")).alias("channel"), "value")

    def pair_list(self, directed: bool, pairs: Iterable[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
        names = list(self.channels)
        if pairs is None:
            if directed:
                return [(a, b) for a in names for b in names if a != b]
            return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        rank = {c: i for i, c in enumerate(names)}
        out: dict[tuple[str, str], None] = {}
        for a, b in pairs:
            if a not in rank or b not in rank or a == b:
                continue
            out[(a, b) if directed or rank[a] < rank[b] else (b, a)] = None
        return list(out)

    def shifted(self, lags: Sequence[int]) -> DataFrame:
        """Frame plus ``<channel>@<lag>`` columns holding the value ``lag`` positions ahead."""
        ahead = sorted({int(v) for v in lags if v})
        if not ahead:
            return self.frame

        def exprs(w):
            return {f"{c}@{v}": F.lead(self.col(c), v).over(w) for c in self.channels for v in ahead}

        return rolling(self.frame, [], "t", exprs, after=max(ahead), size=self.block)

    def pair_points(
        self,
        directed: bool,
        pairs: Iterable[tuple[str, str]] | None = None,
        lags: Sequence[int] = (0,),
    ) -> DataFrame:
        """``src, dst, lag, t, x, y`` for every listed pair with both values present.

        A narrow expansion of each row (one output row per pair and lag); y is taken
        ``lag`` positions ahead.
        """
        if pairs is None and len(self.channels) > MANY_CHANNELS:
            return self._all_pair_points(directed, lags)
        todo = self.pair_list(directed, pairs)
        shifts = sorted({int(v) for v in lags if v})
        base = {0: 0, **{v: len(self.channels) * (i + 1) for i, v in enumerate(shifts)}}
        values = [self.col(c) for c in self.channels] + [F.col(f"`{c}@{v}`") for v in shifts for c in self.channels]
        combos = [(a, b, v) for a, b in todo for v in lags]
        index = self.pair_index(combos, {v: base[int(v)] for v in lags})
        out = self.shifted(lags).select("t", F.array(*values).alias("v"), F.explode(index).alias("c"))
        out = out.select("c.src", "c.dst", "c.lag", "t", F.get("v", F.col("c.i")).alias("x"), F.get("v", F.col("c.j")).alias("y"))
        return out.filter("x IS NOT NULL AND y IS NOT NULL")

    def _all_pair_points(self, directed: bool, lags: Sequence[int]) -> DataFrame:
        """All pairs by two nested explodes of the row's value array (no constant list of pairs)."""
        n = len(self.channels)
        names = F.from_json(F.lit(json.dumps(list(self.channels))), "array<string>")
        ahead = [
            F.struct(F.lit(int(v)).alias("lag"), F.array(*[F.col(f"`{c}@{v}`") if v else self.col(c) for c in self.channels]).alias("w"))
            for v in lags
        ]
        own = F.array(*[self.col(c) for c in self.channels]).alias("v")
        rows = self.shifted(lags).select("t", own, F.explode(F.array(*ahead)).alias("l")).select("t", "v", "l.lag", "l.w")
        first = rows.select("t", "lag", "w", F.posexplode("v").alias("i", "x")).filter("x IS NOT NULL")
        if directed:
            both = first.select("t", "lag", "i", "x", F.posexplode("w").alias("j", "y")).filter("i <> j")
        else:
            rest = F.posexplode(F.slice("w", F.col("i") + 2, n)).alias("d", "y")
            both = first.select("t", "lag", "i", "x", rest).withColumn("j", F.col("i") + F.col("d") + 1)
        return both.filter("y IS NOT NULL").select(
            F.get(names, F.col("i")).alias("src"), F.get(names, F.col("j")).alias("dst"), "lag", "t", "x", "y"
        )

    def pair_index(self, combos: Sequence[tuple[str, str, int]], base: dict[int, int] | None = None) -> Column:
        """Constant array of (src, dst, lag, i, j): pairs with the slots of both values.

        One constant and one explode keep generated code small however many pairs there are.
        """
        rank = {c: i for i, c in enumerate(self.channels)}
        rows = [
            {"src": a, "dst": b, "lag": int(v), "i": rank[a], "j": rank[b] + (base or {}).get(v, 0)} for a, b, v in combos
        ]
        schema = "array<struct<src: string, dst: string, lag: int, i: int, j: int>>"
        return F.from_json(F.lit(json.dumps(rows)), schema)
