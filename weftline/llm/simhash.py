"""SimHash near duplicates by exact tiled comparison.

A fingerprint has a bit for each bit that over half of the text's shingle hashes have.  Equal fingerprints
collapse first.  Distinct ones go into tiles by the population counts of their upper and lower half; tiles
whose counts differ by more than the radius never meet, as every differing bit moves a count by one.  Two
tiles that meet are compared in blocks, ordered by the counts of the eight bytes: a pair of blocks is
skipped where the least sum of differences of these counts is beyond the radius, all others are
compared by exclusive or and bit counts.  A pair of tiles sends a star for each component it finds, never
all its links, and stars of all tiles meet in connected components.

The comparison is exact, so its work grows with the square of the number of distinct fingerprints; the
skipped blocks make the factor small.  No task ever holds more than two tiles.

Defined results: texts without words have fingerprint zero and link with each other; a text shorter than
a shingle is one shingle; a component is named by its smallest id, null ids never name one that has
another; repeated rows are members like others; very long texts are used whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import attach, flat_bytes, pieces_for, ready, staged, with_row
from weftline.llm.minhash import components

SEED = 42
PIECE = 1 << 14
TILE = 1 << 15
BLOCK = 256
BITS = 64


def fingerprint(raw: bytes, width: int) -> int:
    """The fingerprint of a text's bytes (A-Z lowered, words between ASCII spaces)."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    take = min(width, len(words))
    places = list(zip(starts[: len(words) - take + 1].tolist(), ends[take - 1 :].tolist()))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(places), PIECE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in places[at : at + PIECE]], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(places), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """``row`` and ``fp`` (the 64 bits as a long) of every row."""
    held = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            raw = data.tobytes()
            found = np.array([fingerprint(raw[a:b], width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found.view(np.int64))], names=["row", "fp"])

    return held.mapInArrow(run, with_row(held, "fp long"))


def _tiles(distinct: DataFrame) -> DataFrame:
    """``hi, lo, part, fps``: packed tiles of at most about ``TILE`` fingerprints with the same two counts."""

    def half(shift: int):
        return F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")

    cells = distinct.select("fp", half(32).alias("hi"), half(0).alias("lo"))
    # at most 33 * 33 cells, so this list is small whatever the input
    sizes = F.broadcast(cells.groupBy("hi", "lo").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")))
    placed = cells.join(sizes, ["hi", "lo"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    packed = placed.groupBy("hi", "lo", "part", "parts").agg(F.collect_list("fp").alias("fps"))
    return staged(packed, "tiles")


def _meetings(tiles: DataFrame, radius: int) -> DataFrame:
    """Each tile (role 0) and, once for each tile it meets, that one's fingerprints (role 1), under the first one's name."""
    name = F.struct("hi", "lo", "part").alias("tile")
    offsets = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if abs(a) + abs(b) <= radius and (a, b) > (0, 0)]
    sizes = tiles.select("hi", "lo", "parts").distinct()
    around = F.explode(F.array(*[F.struct((F.col("hi") + a).alias("h"), (F.col("lo") + b).alias("l")) for a, b in offsets]))
    other = sizes.select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.col("parts").alias("theirs"))
    # numbers of tiles only: a tile goes to every part of half of the cells around it, and to earlier parts of its own
    near = sizes.withColumn("x", around).select("hi", "lo", "x.h", "x.l").join(other, ["h", "l"])
    same = sizes.select(F.col("hi").alias("h"), F.col("lo").alias("l"), "hi", "lo", F.col("parts").alias("theirs"))
    goes = near.unionByName(same).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
    sent = tiles.join(goes, ["hi", "lo"]).filter("hi <> h or lo <> l or to < part")
    return tiles.select(name, F.lit(0).alias("role"), "fps").unionByName(sent.select(F.struct(F.col("h").alias("hi"), F.col("l").alias("lo"), F.col("to").alias("part")).alias("tile"), F.lit(1).alias("role"), "fps"))


class Tile:
    """Fingerprints in blocks of like byte counts."""

    def __init__(self, fps: np.ndarray):
        counts = np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int8)
        order = np.lexsort(counts.T[::-1])
        self.fps, counts = fps[order], counts[order]
        self.at = np.arange(0, len(fps), BLOCK)
        self.low, self.high = np.minimum.reduceat(counts, self.at), np.maximum.reduceat(counts, self.at)

    def links(self, other: Tile, radius: int):
        """Places (mine, theirs) of fingerprints at most ``radius`` bits apart, block by block."""
        for i, a in enumerate(self.at.tolist()):
            gap = np.maximum(np.maximum(other.low - self.high[i], self.low[i] - other.high), 0).sum(axis=1, dtype=np.int64)
            mine = self.fps[a : a + BLOCK]
            for j in np.flatnonzero(gap <= radius).tolist():
                b = int(other.at[j])
                if other is self and b < a:
                    continue
                apart = np.bitwise_count(mine[:, None] ^ other.fps[None, b : b + BLOCK])
                x, y = np.nonzero(apart <= radius)
                if len(x):
                    yield x + a, y + b


def _gathered(links):
    held, n = [], 0
    for x, y in links:
        held.append((x, y))
        n += len(x)
        if n >= PIECE:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _stars(ours: np.ndarray, theirs: np.ndarray, links) -> tuple[np.ndarray, np.ndarray]:
    """Links of the fingerprints to the least of their component, as far as these links tell."""
    values = np.concatenate([ours, theirs])
    label = np.arange(len(values))
    for x, y in _gathered(links):
        y = y + len(ours) * (len(theirs) > 0)
        while True:
            a, b = label[x], label[y]
            apart = a != b
            if not apart.any():
                break
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return values[moved], values[label[moved]]


def linked(distinct: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` that join all of ``distinct(fp)`` within ``radius`` bits into their components."""
    spark = distinct.sparkSession
    met = _meetings(_tiles(distinct), radius)
    parts = pieces_for(spark, distinct.count(), TILE)
    dealt = met.repartition(parts, "tile").sortWithinPartitions("tile", "role")

    def run(batches):
        import pyarrow as pa

        own = None
        for batch in batches:
            fps = batch.column("fps")
            for k, role in enumerate(batch.column("role").to_pylist()):
                tile = Tile(fps[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                if role == 0:
                    own = tile
                    a, b = _stars(own.fps, np.empty(0, np.uint64), own.links(own, radius))
                else:
                    a, b = _stars(own.fps, tile.fps, own.links(tile, radius))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.select("role", "fps").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``: its 64 bits as a long, and the smallest id it reaches."""
    ready(docs.sparkSession)
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = staged(fingerprints(held, width, "text").select(F.col("row.doc_id").alias("doc_id"), "fp"), "fingerprints")
    distinct = staged(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comps = components(staged(linked(distinct.select("fp"), radius), "links"))
    labelled = distinct.join(comps.withColumnRenamed("uid", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    names = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    return attach(base, attach(staged(labelled, "labelled"), names, "comp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
