"""K-d tree partitioning by distributed weighted medians; DataFrame operations only.

Every node of the tree is cut along its widest metadata dimension at the weighted quantile that
gives each side its share of the bytes, until each leaf holds one shard's target.  The quantile is
found exactly by counting: a few passes add up bytes per digit of a 63-bit sort key, so no node is
ever sorted or collected.  The driver sees one row per node and pass.

Equal texts share their coordinates if the dimensions do, and stay together unless a group is
heavier than ``tolerance`` of the target; such a group is split by row.

Defined results: a null text has no bytes and weighs 1; null dimensions count as the lowest value;
null and repeated ids are rows like others; an empty table gives no rows; only the named columns
are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import blank_null, ready, staged

TOP = (1 << 31) - 1
DIGITS = ((47, 16), (31, 16), (15, 16), (0, 15))
ROW_DIGITS = ((16, 16), (0, 16))
BLOCK_ROWS = 50_000
DIMENSIONS = ("lang", "n_chars")


@dataclass
class Node:
    first: int  # its first leaf
    leaves: int
    weight: int
    dim: int = 0
    cut: int = 0  # rows with a smaller key go left
    row_cut: int = -1  # of rows with the key itself, those up to this number go left


def _of_node(facts: dict[int, int]) -> Column:
    """A node's number looked up in a literal; null for nodes not in it (at most one entry per leaf)."""
    return F.element_at(F.create_map(*[F.lit(x).cast(k) for node, v in facts.items() for x, k in ((node, "int"), (v, "long"))]), F.col("node"))


def _coordinate(kind: str, c: str) -> Column:
    """A column as a number: numbers as they are, other values by a hash that keeps equal values equal."""
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.coalesce(F.crc32(F.col(c).cast("string")).cast("double"), F.lit(0.0))


def _search(rows: DataFrame, nodes: list[Node], key: str, digits, below: dict[int, int], target: dict[int, int]):
    """Per node the smallest key whose running weight reaches the target, its weight, and the weight below it."""
    prefix, weight = {n.first: 0 for n in nodes}, {}
    for shift, width in digits:
        counted = (
            rows.filter(F.shiftright(key, shift + width) == _of_node(prefix))
            .groupBy("node", F.expr(f"shiftright({key}, {shift}) & {(1 << width) - 1}").alias("digit"))
            .agg(F.sum("size").alias("w"))
        )
        run = F.sum("w").over(W.partitionBy("node").orderBy("digit"))
        found = (
            counted.withColumn("upto", _of_node(below) + run)
            .filter(F.col("upto") >= _of_node(target))
            .groupBy("node")
            .agg(F.min(F.struct("digit", "upto", "w")).alias("hit"))
            .collect()
        )
        for r in found:
            prefix[r["node"]] = (prefix[r["node"]] << width) | r["hit"]["digit"]
            below[r["node"]] = r["hit"]["upto"] - r["hit"]["w"]
            weight[r["node"]] = r["hit"]["w"]
    return prefix, weight, below


def _descend(rows: DataFrame, nodes: list[Node], dims: int) -> DataFrame:
    """Move the rows of ``nodes`` to the left or right child."""
    of = lambda f: _of_node({n.first: f(n) for n in nodes})
    held = rows.withColumn("dim", of(lambda n: n.dim))
    key, cut = _key(dims), of(lambda n: n.cut)
    left = (key < cut) | ((key == cut) & (F.col("u") <= of(lambda n: n.row_cut)))
    right = of(lambda n: n.first + n.leaves // 2)
    return held.withColumn("node", F.when(F.col("dim").isNull() | left, F.col("node")).otherwise(right).cast("int")).drop("dim")


def _key(dims: int) -> Column:
    chosen = F.element_at(F.array(*[f"c{k}" for k in range(dims)]), (F.col("dim") + 1).cast("int"))
    return F.shiftleft(chosen, 32) + F.col("g")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions=DIMENSIONS, tolerance: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: sizes near equal, slots gapless in each shard.

    Give the number of ``shards`` or the ``target_bytes`` of a leaf (then 2^k or more leaves as the total asks).
    """
    spark = ready(docs.sparkSession)
    kinds = dict(docs.dtypes)
    text = blank_null(text_col)
    base = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.expr("shiftrightunsigned(xxhash64(coalesce(" + text_col + ", '')), 32)").alias("g"),
            F.monotonically_increasing_id().alias("uid"),
            *[_coordinate(kinds[d], d).alias(f"d{k}") for k, d in enumerate(dimensions)],
        ),
        "shard-rows",
    )
    n = len(dimensions)
    facts = base.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[f(f"d{k}").alias(f"{f.__name__}{k}") for k in range(n) for f in (F.min, F.max)]).first()
    total = facts["bytes"] or 0
    leaves = shards if shards is not None else max(1, -(-total // target_bytes))
    goal = total / leaves
    unit = [F.floor((F.col(f"d{k}") - (facts[f"min{k}"] or 0.0)) / max((facts[f"max{k}"] or 0.0) - (facts[f"min{k}"] or 0.0), 1e-300) * TOP).cast("long") for k in range(n)]
    rows = base.select("doc_id", "size", "text_crc32", "g", "uid", F.expr("shiftrightunsigned(xxhash64(uid), 32)").alias("u"), F.lit(0).alias("node"), *[u.alias(f"c{k}") for k, u in enumerate(unit)])
    todo = [Node(0, leaves, total)] if total and leaves > 1 else []
    while todo:
        spans = {
            r["node"]: [r[f"w{k}"] for k in range(n)]
            for r in rows.filter(F.col("node").isin([x.first for x in todo])).groupBy("node").agg(*[(F.max(f"c{k}") - F.min(f"c{k}")).alias(f"w{k}") for k in range(n)]).collect()
        }
        todo = [x for x in todo if x.first in spans]
        if not todo:
            break
        for x in todo:
            x.dim = max(range(n), key=lambda k: (spans[x.first][k], -k))
        dim = _of_node({x.first: x.dim for x in todo})
        keyed = rows.withColumn("dim", dim).filter("dim is not null").withColumn("key", _key(n))
        target = {x.first: max(1, x.weight * (x.leaves // 2) // x.leaves) for x in todo}
        keys, weight, below = _search(keyed, todo, "key", DIGITS, {x.first: 0 for x in todo}, target)
        heavy = []
        for x in todo:
            x.cut, a = keys[x.first], x.first
            if weight[a] > tolerance * goal:
                heavy.append(x)
            else:
                whole_left = below[a] + weight[a] - target[a] <= target[a] - below[a]
                x.row_cut = (1 << 32) if whole_left else -1
                x.left = below[a] + (weight[a] if whole_left else 0)
        if heavy:
            same = keyed.filter(F.col("key") == _of_node({x.first: x.cut for x in heavy}))
            rows_at, _, under = _search(same, heavy, "u", ROW_DIGITS, {x.first: below[x.first] for x in heavy}, target)
            for x in heavy:
                x.row_cut = rows_at[x.first] - 1
                x.left = under[x.first]
        rows = staged(_descend(rows, todo, n), "shard-level")
        todo = [
            y
            for x in todo
            for y in (Node(x.first, x.leaves // 2, x.left), Node(x.first + x.leaves // 2, x.leaves - x.leaves // 2, x.weight - x.left))
            if y.leaves > 1 and y.weight > 0
        ]
    return _slots(rows, facts["rows"] or 0, leaves)


def _slots(rows: DataFrame, count: int, leaves: int) -> DataFrame:
    """Number the rows of each shard: blocks of bounded size are numbered apart, then shifted."""
    blocks = max(1, count // (leaves * BLOCK_ROWS) * 2)
    held = rows.withColumn("block", F.expr(f"pmod(xxhash64(u), {blocks})"))
    counts = held.groupBy("node", "block").agg(F.count("*").alias("c"))
    bases = counts.select("node", "block", (F.sum("c").over(W.partitionBy("node").orderBy("block")) - F.col("c")).alias("base"))
    numbered = held.withColumn("at", F.row_number().over(W.partitionBy("node", "block").orderBy("uid")) - 1)
    return numbered.join(bases, ["node", "block"]).select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), (F.col("base") + F.col("at")).alias("slot"))
