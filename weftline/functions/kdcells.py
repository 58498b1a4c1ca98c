"""Partition trees: groups of points cut into cells of bounded size along all their coordinates.

A node with more points than the bound is cut along its widest coordinate at quantiles from a sketch; a
value that fills a whole part gets a child of its own.  Rounds go on until every cell is within the bound,
so a cell's size depends on neither the group's nor the session's settings.  Distinct points can always be
told apart by some coordinate, so repeated values cannot keep a cell large.

``near_cells`` walks the tree from the root for each cell, not for each point.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.quantiles import sketch
from weftline.functions.strips import count_below, tops
from weftline.session import staged

CELL = 1024
FAN = 128
ACCURACY = 4000
BROADCAST_BYTES = 32 << 20
INFINITE = float("inf")


@dataclass(frozen=True)
class Tree:
    """``cells``: the points with ``leaf`` and the extents ``wide`` and ``diag`` of the node above it; ``depth``: 0 if no group was cut."""

    cells: DataFrame
    depth: int
    dims: int


def _extent(c: Column, dims: int, fn) -> Column:
    return F.array(*[fn(F.get(c, F.lit(i))) for i in range(dims)])


def _bounded_join(df: DataFrame, nodes: DataFrame, on: list[str], bytes_: int) -> DataFrame:
    """Join rows to facts of their node, which travel to all tasks while they are small."""
    return df.join(F.broadcast(nodes) if bytes_ <= BROADCAST_BYTES else nodes, on)


def grow(points: DataFrame, keys: Sequence[str], cell: int = CELL) -> Tree:
    """Cells of at most ``cell`` rows; ``points`` has the keys and coordinates ``c`` (equal ones are cut only where they differ)."""
    keys = list(keys)
    dims = points.agg(F.max(F.size("c"))).first()[0] or 1
    state = points.withColumn("leaf", F.lit("")).withColumn("wide", F.lit(INFINITE)).withColumn("diag", F.lit(INFINITE))
    at = [*keys, "leaf"]
    depth = 0
    while True:
        size = state.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), _extent(F.col("c"), dims, F.min).alias("_lo"), _extent(F.col("c"), dims, F.max).alias("_hi"))
        span = F.zip_with("_hi", "_lo", lambda a, b: F.coalesce(a - b, F.lit(0.0)))
        size = size.withColumn("_span", span).withColumn("_wide", F.array_max("_span"))
        size = staged(size.filter((F.col("_n") > cell) & (F.col("_wide") > 0)).select(*at, "_n", "_span", "_wide"))
        nodes = size.count()
        if not nodes:
            break
        if not depth:
            state = staged(state)
        depth += 1
        parts = F.ceil(F.col("_n") / (0.75 * cell))
        # cells of about equal sides: as many cuts as the root of the number of cells wanted, or all where they are few
        ways = F.least(F.lit(FAN), F.when(parts <= 16, parts).otherwise(F.greatest(F.lit(16), F.ceil(F.sqrt(parts))))).cast("int")
        diag = F.sqrt(F.aggregate("_span", F.lit(0.0), lambda a, x: a + x * x))
        plan = size.select(*at, ways.alias("_ways"), (F.array_position("_span", F.col("_wide")) - 1).cast("int").alias("_axis"), F.col("_wide"), diag.alias("_diag"))
        cut_rows = _bounded_join(state, plan, at, nodes * 200).withColumn("_v", F.get("c", F.col("_axis")))
        grid = [i / FAN for i in range(1, FAN)]
        seen = cut_rows.groupBy(*at).agg(sketch("_v", grid, ACCURACY).alias("_g"), F.first("_ways").alias("_ways"), F.first("_axis").alias("_axis"), F.first("_wide").alias("_wide"), F.first("_diag").alias("_diag"), F.max("_v").alias("_most"))
        picked = F.transform(F.sequence(F.lit(1), F.col("_ways") - 1), lambda i: F.get("_g", F.floor(i * FAN / F.col("_ways")).cast("int") - 1))
        seen = seen.withColumn("_picked", picked)
        again = F.array_distinct(F.filter("_picked", lambda s, i: (i > 0) & (F.get("_picked", i - 1) == s)))
        # parts reach up to their cut, so one at the greatest value takes nothing off unless that value is a part of its own
        most = F.when(F.array_contains("_picked", F.col("_most")), F.array("_most")).otherwise(F.array().cast("array<double>"))
        seen = seen.withColumn("_cut", F.array_distinct("_picked")).withColumn("_own", F.array_union(again, most)).withColumn("_top", tops(F.col("_cut")))
        seen = staged(seen.select(*at, "_cut", "_top", "_own", "_axis", F.col("_wide").alias("_w"), F.col("_diag").alias("_d")))
        facts = _left_bounded(state, seen, at, nodes * (24 * FAN + 100)).withColumn("_v", F.get("c", F.col("_axis")))
        code = count_below(F.col("_cut"), F.col("_top"), F.col("_v")) * 2 + F.array_contains("_own", F.col("_v")).cast("int")
        split = F.col("_cut").isNotNull()
        state = staged(
            facts.withColumn("leaf", F.when(split, F.concat("leaf", F.lit("."), code.cast("string"))).otherwise(F.col("leaf")))
            .withColumn("wide", F.coalesce("_w", "wide")).withColumn("diag", F.coalesce("_d", "diag"))
            .drop("_cut", "_top", "_own", "_axis", "_w", "_d", "_v")
        )
    return Tree(state, depth, dims)


def _left_bounded(df: DataFrame, nodes: DataFrame, on: list[str], bytes_: int) -> DataFrame:
    return df.join(F.broadcast(nodes) if bytes_ <= BROADCAST_BYTES else nodes, on, "left")


def boxes(tree: Tree, keys: Sequence[str], weight: Column) -> DataFrame:
    """``keys, leaf, lo, hi, wt``: bounds and weight of each cell's rows of positive ``weight``."""
    held = tree.cells.withColumn("_wt", weight).filter("_wt > 0")
    return held.groupBy(*keys, "leaf").agg(_extent(F.col("c"), tree.dims, F.min).alias("lo"), _extent(F.col("c"), tree.dims, F.max).alias("hi"), F.sum("_wt").alias("wt"))


def _children(leaves: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """``keys, node, kids``: the children of every inner node with their bounds; a node has some hundred at most."""
    path = F.split("leaf", "\\.")
    name = lambda j: F.array_join(F.slice(path, F.lit(1), j), ".")
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda j: F.struct(name(j).alias("node"), name(j + 1).alias("kid"))))
    one = leaves.filter("leaf <> ''").select(*keys, "leaf", "lo", "hi", steps.alias("s"))
    kid = one.groupBy(*keys, F.col("s.node").alias("node"), F.col("s.kid").alias("kid")).agg(
        _extent(F.col("lo"), dims, F.min).alias("lo"), _extent(F.col("hi"), dims, F.max).alias("hi"), F.max(F.col("leaf") == F.col("s.kid")).alias("last")
    )
    return kid.groupBy(*keys, "node").agg(F.collect_list(F.struct("kid", "lo", "hi", "last")).alias("kids"))


def gap(lo: Column, hi: Column, other_lo: Column, other_hi: Column, dims: int) -> Column:
    """Largest distance of two boxes along one coordinate."""
    sides = [F.coalesce(F.greatest(F.get(other_lo, F.lit(i)) - F.get(hi, F.lit(i)), F.get(lo, F.lit(i)) - F.get(other_hi, F.lit(i)), F.lit(0.0)), F.lit(0.0)) for i in range(dims)]
    return F.greatest(*sides) if dims > 1 else sides[0]


def near_cells(tree: Tree, leaves: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, leaf, other``: other cells that a point of a cell may reach.

    ``leaves``: ``boxes`` of the points to be found; ``starts``: ``keys, leaf, lo, hi, reach`` of the cells to start from.
    """
    keys = list(keys)
    kids = staged(_children(leaves, keys, tree.dims))
    front = starts.filter("leaf <> ''").withColumn("node", F.lit(""))
    found = None
    for _ in range(tree.depth):
        met = front.join(kids, [*keys, "node"])
        close = F.filter("kids", lambda x: gap(F.col("lo"), F.col("hi"), x["lo"], x["hi"], tree.dims) <= F.col("reach") * (1 + 1e-9) + 1e-300)
        met = staged(met.select(*keys, "leaf", "lo", "hi", "reach", F.explode(close).alias("x")).select(*keys, "leaf", "lo", "hi", "reach", F.col("x.kid").alias("node"), F.col("x.last").alias("last")))
        done = met.filter("last").filter("node <> leaf").select(*keys, "leaf", F.col("node").alias("other"))
        found = done if found is None else found.unionByName(done)
        front = met.filter("not last").drop("last")
    return found
