"""Prefix trie of conversations by vertical bitmaps.

Turns are sorted by conversation and depth over all partitions.  A task cuts its rows into shards of
consecutive conversations and indexes each shard: for every (depth, turn) the set of its conversations, as
the bits of one integer.  Depth first, the lowest conversation left in a node names the next turn, and the
node's bits and those of that turn's posting give the child: its bits count its members, the lowest one is its
smallest member, and the bits that end there are its end list.

A node is known by its depth and two sums of hashes of (depth, turn) along its path, so shards agree on it and
their nodes add up.  A conversation that a partition cuts goes on in the next one from the sums so far, so
neither long conversations nor common turns gather in one task.  Sums over subtrees take one round per
doubling of the depth: a node passes its total to the ancestor as far up as the total reaches down.

Defined results: rows without a conversation id belong to none; null role and text are empty; turns of equal
number are ordered by role, then text; a conversation without turns is a member of the root alone; without
any conversation there is no node.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import attach, blank_null, numbered, ready, shuffle_parts, staged

SHARD_CONVERSATIONS = 2048
SHARD_TURNS = 1 << 15
M64 = (1 << 64) - 1


def turns(rows: DataFrame) -> DataFrame:
    """``conv, depth, t, chars, total``: the turns of every conversation from 1 on, texts replaced by a 128-bit hash and their code points."""
    held = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", blank_null("role").alias("role"), blank_null("text").alias("text"))
    t = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    held = held.select("*", t.alias("t"), F.char_length("text").cast("long").alias("chars"))
    return numbered(held, "conv", ["turn", "role", "text"], ["t", "chars"]).select("conv", (F.col("pos") + 1).alias("depth"), "t", "chars", "total")


def with_shared_heads(own: DataFrame, every: int, most: int) -> DataFrame:
    """Conversations that begin with the first turns of the one at the multiple of ``every`` below them, as far as these reach.

    ``own`` is what ``turns`` returns.  The number of such turns is the CRC-32 of the id modulo ``most``.
    """
    h = F.crc32(F.col("conv").cast("string")) % most
    sizes = staged(own.groupBy("conv").agg(F.count("*").alias("own")), "lengths")
    bases = sizes.filter(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.col("own").alias("has"))
    plans = sizes.withColumn("base", F.col("conv") - F.col("conv") % every).join(bases, "base", "left")
    plans = plans.withColumn("h", h).withColumn("shared", F.least("h", F.coalesce("has", F.lit(0)).cast("long")))
    plans = staged(plans.select("conv", "base", "shared", (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "heads")
    heads = plans.filter("shared > 0").withColumn("depth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("shared"))))
    first = own.filter(f"conv % {every} = 0 and depth < {most}").select(F.col("conv").alias("base"), "depth", "t", "chars")
    heads = heads.join(first, ["base", "depth"]).select("conv", "depth", "t", "chars", "length")
    rest = attach(staged(own.filter(F.col("depth") > h).withColumn("h", h), "rest"), plans, "conv")
    rest = rest.select("conv", (F.col("depth") - F.col("h") + F.col("shared")).alias("depth"), "t", "chars", "length")
    start = plans.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("t"), F.lit(0).cast("long").alias("chars"), "length")
    return start.unionByName(heads).unionByName(rest)


def plain(own: DataFrame) -> DataFrame:
    """Conversations as they are, with a row of depth 0 each."""
    start = own.groupBy("conv").agg(F.max("total").alias("length")).select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("t"), F.lit(0).cast("long").alias("chars"), "length")
    return start.unionByName(own.select("conv", "depth", "t", "chars", F.col("total").alias("length")))


def _bits(x: int):
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


class Shard:
    """Consecutive conversations: ids, the node each one starts from, and the turns after it."""

    def __init__(self):
        self.ids: list[int] = []
        self.starts: list[tuple[int, int, int, bool]] = []
        self.turns: list[list[tuple[int, int, int]]] = []
        self.ended: list[bool] = []
        self.size = 0

    def open(self, conv: int, start: tuple[int, int, int], fresh: bool) -> None:
        """Begin a conversation, or go on with one (not ``fresh``) whose start is known elsewhere already."""
        self.ids.append(conv)
        self.starts.append((*start, fresh))
        self.turns.append([])
        self.ended.append(False)
        self.reached = start

    def add(self, depth: int, a: int, b: int, chars: int, last: bool) -> None:
        if depth:
            self.turns[-1].append((a, b, chars))
            self.reached = (depth, self.reached[1] + a & M64, self.reached[2] + b & M64)
            self.size += 1
        self.ended[-1] = last

    def nodes(self):
        """Depth, two sums, the parent's two, characters, number of members, smallest, ends (packed ids or None)."""
        postings: dict[tuple, list[int]] = {}
        roots: dict[tuple, int] = {}
        ends: dict[int, int] = {}
        for i, (start, own) in enumerate(zip(self.starts, self.turns)):
            roots[start] = roots.get(start, 0) | 1 << i
            for k, (a, b, _) in enumerate(own):
                postings.setdefault((start[0] + k + 1, a, b), []).append(i)
            at = start[0] + len(own)
            ends[at] = ends.get(at, 0) | 1 << i
        index = {k: self._packed(v) for k, v in postings.items()}
        for (depth, a, b, fresh), bits in roots.items():
            if fresh:
                yield 0, 0, 0, 0, 0, 0, *self._members(bits, ends.get(0, 0))
            stack = [(depth, a, b, bits)]
            while stack:
                depth, a, b, bits = stack.pop()
                rest = bits & ~ends.get(depth, 0)
                while rest:
                    i = (rest & -rest).bit_length() - 1
                    x, y, chars = self.turns[i][depth - self.starts[i][0]]
                    child = rest & index[(depth + 1, x, y)]
                    rest ^= child
                    node = (depth + 1, a + x & M64, b + y & M64)
                    yield *node, a, b, chars, *self._members(child, ends.get(depth + 1, 0))
                    stack.append((*node, child))

    @staticmethod
    def _packed(members: list[int]) -> int:
        out = np.zeros(members[-1] + 1, np.uint8)
        out[members] = 1
        return int.from_bytes(np.packbits(out, bitorder="little").tobytes(), "little")

    def _members(self, bits: int, ending: int) -> tuple[int, int, bytes | None]:
        done = [self.ids[i] for i in _bits(bits & ending) if self.ended[i]]
        return bits.bit_count(), self.ids[(bits & -bits).bit_length() - 1], np.array(done, np.int64).tobytes() if done else None


def _carried(rows: DataFrame) -> dict[int, tuple[int, int, int]]:
    """For each partition that begins inside a conversation: the depth reached before it, and the two sums; one entry a partition at most."""
    cut = rows.groupBy("part").agg(F.min("at").alias("at")).join(rows, ["part", "at"]).filter("depth > 0").select("part", "conv", "depth")
    convs = F.broadcast(cut.select("conv").distinct())
    wide = "decimal(38,0)"
    sums = rows.join(convs, "conv").groupBy("conv", "part").agg(F.sum(F.col("k1").cast(wide)).alias("s1"), F.sum(F.col("k2").cast(wide)).alias("s2"), F.min("depth").alias("d"))
    out, reached = {}, {}
    for r in sorted(sums.collect(), key=lambda r: r["part"]):
        a, b = reached.get(r["conv"], (0, 0))
        if r["d"] > 0:
            # only the first conversation of a partition can have begun before it
            out[r["part"]] = (r["d"] - 1, a, b)
        reached[r["conv"]] = (a + int(r["s1"]) & M64, b + int(r["s2"]) & M64)
    return out


def shard_nodes(rebuilt: DataFrame) -> DataFrame:
    """Nodes of every shard: ``depth, a, b, pa, pb, chars, n, least, ends``."""
    root = F.col("depth") == 0
    k1 = F.when(root, 0).otherwise(F.xxhash64("depth", "t"))
    k2 = F.when(root, 0).otherwise(F.xxhash64("t", "depth", F.lit(1)))
    keyed = rebuilt.select("conv", "depth", "chars", k1.cast("long").alias("k1"), k2.cast("long").alias("k2"), (F.col("depth") == F.col("length")).alias("last"))
    by = ["conv", "depth"]
    parts = shuffle_parts(rebuilt.sparkSession)
    rows = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    rows = staged(rows.select("*", at.alias("at"), F.shiftright(at, 33).alias("part")), "rebuilt")
    carried = _carried(rows)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 8 + [pa.binary()]
        names = ["depth", "a", "b", "pa", "pb", "chars", "n", "least", "ends"]

        def out(shard):
            found = list(shard.nodes())
            for at in range(0, len(found), 4096):
                cols = list(zip(*found[at : at + 4096]))
                signed = [np.array(c, np.uint64).view(np.int64) for c in cols[1:5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([cols[0], *signed, *cols[5:]], kinds)], names=names)

        shard, part, current = Shard(), None, None
        for batch in batches:
            for p, conv, depth, a, b, chars, last in zip(*(batch.column(c).to_pylist() for c in ("part", "conv", "depth", "k1", "k2", "chars", "last"))):
                new = p != part or conv != current
                if new or shard.size >= SHARD_TURNS:
                    begun = None if new else shard.reached
                    if shard.ids and (p != part or shard.size >= SHARD_TURNS or len(shard.ids) >= SHARD_CONVERSATIONS):
                        yield from out(shard)
                        shard = Shard()
                    if depth and begun is None:
                        begun = carried[p]
                    shard.open(conv, begun or (0, 0, 0), fresh=not depth)
                    part, current = p, conv
                shard.add(depth, a & M64, b & M64, chars, last)
        if shard.ids:
            yield from out(shard)

    ordered = rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("at")
    return ordered.select("part", "conv", "depth", "k1", "k2", "chars", "last").mapInArrow(run, "depth long, a long, b long, pa long, pb long, chars long, n long, least long, ends binary")


def _end_digests(nodes: DataFrame) -> DataFrame:
    """``id, ends_sha256``: shards hold ranges of ids, so their lists follow each other; they are hashed as they pass by."""
    width = np.dtype(np.int64).itemsize
    held = nodes.filter("ends is not null").select("id", F.struct("least", F.octet_length("ends").alias("size")).alias("by"), "ends")
    held = held.repartition(shuffle_parts(nodes.sparkSession), "id").sortWithinPartitions("id", "by")

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        current, state = None, None
        for batch in batches:
            done = []
            for key, ends in zip(batch.column("id").to_pylist(), batch.column("ends").to_pylist()):
                if key != current:
                    if current is not None:
                        done.append((current, state.hexdigest()))
                    current, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                assert len(ends) % width == 0
                state.update(",".join(map(str, np.frombuffer(ends, np.int64).tolist())).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), pa.array([x[1] for x in done])], names=["id", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([state.hexdigest()])], names=["id", "ends_sha256"])

    return held.select("id", "ends").mapInArrow(run, "id struct<depth:long,a:long,b:long>, ends_sha256 string")


def _over_subtrees(own: DataFrame) -> DataFrame:
    """``id, leaves, saved`` summed over the nodes below and including each; ``own(id, up, leaves, saved)`` without the root.

    After round k a node has the totals of the descendants less than 2^k levels below it, and ``up`` names
    its ancestor 2^k levels above; the root is left out, as it is everyone's ancestor.
    """
    held = staged(own, "subtrees")
    while not held.filter("up is not null").isEmpty():
        moved = held.filter("up is not null").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("up", "id")
        above = held.select(F.col("id").alias("up"), F.col("up").alias("next"))
        further = attach(held, above, "up").join(moved, "id", "left")
        added = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        held = staged(further.select("id", F.col("next").alias("up"), added("leaves", "l"), added("saved", "s")), "subtrees")
    return held.select("id", "leaves", "saved")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``rebuilt(conv, depth, t, chars, length)`` has a row of depth 0 for every conversation.
    """
    ready(rebuilt.sparkSession)
    pieces = staged(shard_nodes(rebuilt), "shard-nodes").withColumn("id", F.struct("depth", "a", "b"))
    up = F.when(F.col("id.depth") > 0, F.struct((F.col("id.depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")))
    merged = pieces.groupBy("id", "pa", "pb").agg(F.max("chars").alias("chars"), F.sum("n").alias("n"), F.min("least").alias("least")).withColumn("up", up).drop("pa", "pb")
    merged = staged(merged, "nodes")
    children = merged.filter("up is not null").groupBy("up").agg(F.count("*").alias("children")).withColumnRenamed("up", "id")
    known = staged(merged.join(children, "id", "left").fillna(0, ["children"]), "counted")
    leaf, saved = (F.col("children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved")
    whole = known.agg(F.sum(leaf).alias("leaves"), F.sum(saved).alias("saved")).first()
    below = _over_subtrees(known.filter("up is not null").select("id", F.when(F.col("id.depth") > 1, F.col("up")).alias("up"), leaf, saved))
    rows = attach(known, merged.select(F.col("id").alias("up"), F.col("least").alias("parent")), "up")
    rows = rows.join(below, "id", "left").join(_end_digests(pieces), "id", "left")
    top = F.col("id.depth") == 0
    return rows.select(
        F.col("least").alias("conv_id"), F.col("id.depth").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.when(top, F.lit(whole["leaves"])).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), F.when(top, F.lit(whole["saved"])).otherwise(F.col("saved")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
