"""Merkle manifest of a dataset: a leaf per row, a tree per group, and a tree over the groups' roots.

A node is the SHA-256 (lowercase hex) of its children's hex text, up to sixteen of them.  Rows are
numbered inside their group; an aligned block of 256 keeps each of its levels as one hex string, parents are
hashed from fixed-width substrings, and the substrings left and right of a node are its siblings.  Block
roots are numbered by their blocks already and go through the same step again, until each group has one
node; the groups' roots, in the order of the groups, do likewise.  On the way down every block
hands its nodes the siblings above it.

A group of any size lies in many blocks, and no task ever holds more of it than a block.

Defined results: rows of a group ascend by the order column, null first, then by leaf; repeated rows are
leaves of their own; a null group is a group, before all others; a group of one row has its leaf as root; an
empty table has no rows.  Null fields count as ``-``, empty ones as ``0:``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import numbered, ready, staged

FAN = 16
HEX = 64
RUN = FAN * HEX
BLOCK = FAN * FAN
SIBLINGS = "array<struct<left:string,right:string>>"


def leaf(fields: list[Column]) -> Column:
    """Hash of the fields, each as byte count, colon and value, or ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def levels_of(n: Column) -> Column:
    """Levels above ``n`` leaves: the least number whose power of sixteen holds them."""
    return F.when(n > 1, F.ceil(F.length(F.bin(n - 1)) / 4)).otherwise(0).cast("int")


def _piece(level: Column, start: Column, length: Column | int) -> Column:
    return F.substring(level, start + 1, F.lit(length) if isinstance(length, int) else length)


def _parents(level: Column, nodes: Column) -> Column:
    """The next level's hex string."""
    last = F.ceil(nodes / FAN).cast("int") - 1
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(_piece(level, i * RUN, RUN), 256))
    return F.array_join(hashes, "").cast("binary")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, and ``grp, top`` of every group, from ``grp, pos, todo, node, rest``.

    ``todo`` counts the levels that are still above the nodes; a block has two of its own at most.
    """
    most = nodes.agg(F.max("todo")).first()[0] or 0
    rounds, tops = [], []
    for _ in range(max(1, -(-most // 2))):
        one = F.struct("pos", "node", *(["rest"] if "rest" in nodes.columns else []))
        blocks = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("todo").alias("todo"), F.array_sort(F.collect_list(one)).alias("nodes"))
        blocks = blocks.withColumn("low", F.array_join(F.col("nodes.node"), "").cast("binary"))
        blocks = blocks.withColumn("high", F.when(F.col("todo") > 0, _parents(F.col("low"), F.size("nodes"))))
        top = F.when(F.col("todo") > 1, _parents(F.col("high"), F.ceil(F.size("nodes") / FAN))).otherwise(F.coalesce("high", "low"))
        blocks = staged(blocks.withColumn("top", top.cast("string")), "merkle")
        rounds.append(blocks)
        tops.append(blocks.filter(F.col("todo") <= 2).select("grp", "top"))
        nodes = blocks.filter(F.col("todo") > 2).select("grp", F.col("block").alias("pos"), (F.col("todo") - 2).alias("todo"), F.col("top").alias("node"))
    return rounds, reduce(DataFrame.unionByName, tops)


def _siblings(j: Column) -> Column:
    """Siblings of node ``j`` of a block, inside it, then above it."""
    run = F.floor(j / FAN).cast("int")

    def flanks(level: Column, at: Column, first: Column, end: Column) -> Column:
        return F.struct(_piece(level, first * HEX, (at - first) * HEX).cast("string").alias("left"), _piece(level, (at + 1) * HEX, (end - at - 1) * HEX).cast("string").alias("right"))

    own = F.array(flanks(F.col("low"), j, run * FAN, (run + 1) * FAN), flanks(F.col("high"), run, F.lit(0), F.lit(FAN)))
    return F.concat(F.slice(own, 1, F.least(F.col("todo"), F.lit(2))), F.col("above"))


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Blocks of the lowest round with ``above``; the topmost blocks take theirs from ``above(grp, above)``."""
    higher = None
    for blocks in reversed(rounds):
        held = blocks.filter(F.col("todo") <= 2).join(above, "grp")
        if higher is not None:
            held = held.unionByName(blocks.filter(F.col("todo") > 2).join(higher, ["grp", "block"]))
        lowest = held
        each = F.transform("nodes", lambda x, j: F.struct(x["pos"].alias("block"), _siblings(j).alias("above")))
        higher = held.select("grp", F.explode(each).alias("x")).select("grp", "x.block", "x.above")
    return lowest


def manifest(docs: DataFrame, leaf_hash: Column, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """``order, leaf, subroot, root, siblings`` of every row, and the columns of ``carry``.

    ``siblings`` has the text left and right of the row's node at every level, lowest first.
    """
    ready(docs.sparkSession)
    named = F.struct(F.col(order).alias("order"), *[c.alias(f"c{k}") for k, c in enumerate((carry or {}).values())])
    leaves = docs.select(F.col(group).alias("grp"), F.col(order).alias("order"), leaf_hash.alias("node"), named.alias("rest"))
    rows = numbered(leaves, "grp", ["order", "node"], ["node", "rest"])
    # a struct, so that the null group meets itself in joins
    rounds, tops = _climb(rows.select(F.struct("grp").alias("grp"), "pos", levels_of(F.col("total")).alias("todo"), "node", "rest"))
    groups = staged(tops.select(F.lit(0).alias("all"), F.col("grp.grp").alias("name"), F.col("top").alias("node"), F.struct("grp").alias("rest")), "subroots")
    ordered = numbered(groups, "all", ["name"], ["node", "rest"])
    upper, summit = _climb(ordered.select(F.col("all").alias("grp"), "pos", levels_of(F.col("total")).alias("todo"), "node", "rest"))
    root = (summit.first() or {"top": None})["top"]
    nothing = F.array().cast(SIBLINGS).alias("above")
    held = _descend(upper, summit.select("grp", nothing))
    each = F.transform("nodes", lambda x, j: F.struct(x["rest"]["grp"].alias("grp"), x["node"].alias("subroot"), _siblings(j).alias("above")))
    of_group = staged(held.select(F.explode(each).alias("x")).select("x.*"), "subroot-siblings")
    blocks = _descend(rounds, of_group.select("grp", "above")).join(of_group.select("grp", "subroot"), "grp")
    each = F.transform("nodes", lambda x, j: F.struct(x["node"].alias("leaf"), x["rest"].alias("rest"), _siblings(j).alias("siblings")))
    out = blocks.select("subroot", F.explode(each).alias("x"))
    kept = [F.col(f"x.rest.c{k}").alias(name) for k, name in enumerate(carry or {})]
    return out.select(F.col("x.rest.order").alias(order), "x.leaf", "subroot", F.lit(root).cast("string").alias("root"), "x.siblings", *kept)


def fold(leaf_hash: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(siblings, leaf_hash, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_text(siblings: Column) -> Column:
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")
