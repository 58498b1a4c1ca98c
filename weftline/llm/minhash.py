"""Near duplicates by b-bit MinHash, confirmed on whole shingle sets.

Texts with the same shingle set collapse first.  Each distinct set has 128 minima; 32 bands of four
propose candidates (a pair at the threshold of 0.8 is missed once in 2*10^7), and the low four bits of
each minimum, packed, estimate the similarity with chance matches taken out.  Pairs that the estimate
does not rule out (six standard deviations below the threshold) are confirmed on full sets.

A band's bucket is never paired off.  Its members are first held against one hub; confirmed links
make components.  Members that stay outside their hub's component then meet the rest of the hub's
group in packed blocks: first by packed bits, and where those leave a chance, by full sets.  Only
members with a chance and links that join components leave a task, so rows stay linear in members.

Defined results: null and wordless texts have an empty set and link with nothing; a text shorter
than a shingle is one shingle; a component is named by its smallest id, null ids never name one
that has another; repeated rows are members like others; very long texts are used whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import flat_bytes, mix64, pieces_for, ready, staged, window_hashes, with_row, word_runs

MINIMA, BANDS, BITS = 128, 32, 4
ROWS = MINIMA // BANDS
BLOCK = 512
BLOCK_SHINGLES = 100_000
HUB_ROWS = 500
PART_BYTES = 16 << 20
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
_seeds = mix64(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64))
SCALE, SHIFT = (_seeds[:MINIMA] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_seeds[MINIMA:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    data, offsets = flat_bytes(column)
    _, _, _, row, words = word_runs(data, offsets, WORD)
    ends = np.searchsorted(row, np.arange(len(offsets)))
    grams = window_hashes(words, width)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        out.append(np.unique(grams[a : b - width + 1] if b - a >= width else window_hashes(words[a:b], int(b - a)))if b > a else np.empty(0, np.uint64))
    return out


def minima(found: np.ndarray) -> np.ndarray:
    """The minima of a set's hashes under 128 permutations of 32 bits."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 4096):
        np.minimum(out, (low[a : a + 4096, None] * SCALE + SHIFT).min(axis=0), out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A hash of each band of minima and its number."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS])
    return out.view(np.int64)


def pack_bits(least: np.ndarray) -> bytes:
    """The low four bits of each minimum, two to a byte."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return (low[::2] << np.uint8(4) | low[1::2]).tobytes()


def unpack_bits(packed: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), MINIMA // 2)
    return np.concatenate([raw >> 4, raw & 15], axis=1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from matching low bits, without the matches that chance gives."""
    chance = 2.0**-BITS
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def floor_of(threshold: float) -> float:
    """Estimates below this rule a pair out: six standard deviations below the threshold."""
    return threshold - 6 * np.sqrt(threshold * (1 - threshold) / MINIMA)


def signatures(docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """``row, uid`` with ``n``, two hashes of the set, packed bits and band keys."""
    held = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("uid"))
    schema = with_row(held, "uid long, n long, k1 long, k2 long, sig binary, bands array<long>")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for found in shingle_sets(batch.column("text"), width):
                if not len(found):
                    out.append((0, None, None, None, None))
                    continue
                least = minima(found)
                one = int(mix64(found).sum(dtype=np.uint64).view(np.int64))
                two = int(mix64(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))
                out.append((len(found), one, two, pack_bits(least), band_keys(least)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("uid"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))],
                names=["row", "uid", "n", "k1", "k2", "sig", "bands"],
            )

    return held.mapInArrow(run, schema)


def whole_sets(texts: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """``(uid, found)``: the sorted shingle hashes of the texts that ``needed(uid)`` names."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), width)], pa.binary())], names=["uid", "found"])

    return staged(texts.join(needed.distinct(), "uid", "left_semi").mapInArrow(run, "uid long, found binary"), "sets")


def alike(both: int, a: int, b: int, hundred: int) -> bool:
    return 100 * both >= hundred * (a + b - both)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, hundred: int, parts: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose full sets are similar enough; ``texts(uid, text)`` are distinct sets' texts.

    A hub with many partners is split over salts, and its set goes along once per salt.
    """
    made = whole_sets(texts, pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))), width)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("salts"))
    hubs = salts.join(made, F.col("a") == F.col("uid")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "uid", "found")
    members = (
        pairs.join(salts, "a").withColumn("salt", F.pmod(F.hash("b"), F.col("salts")).cast("int"))
        .join(made, F.col("b") == F.col("uid")).select("a", "salt", F.lit(1).alias("role"), "uid", "found")
    )
    dealt = hubs.unionByName(members).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role")

    def check(batches):
        import pyarrow as pa

        hub = None
        for batch in batches:
            out = []
            for a, role, uid, found in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "uid", "found"))):
                found = np.frombuffer(found, np.uint64)
                if role == 0:
                    hub = found
                elif alike(len(np.intersect1d(hub, found, assume_unique=True)), len(hub), len(found), hundred):
                    out.append((a, uid))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return dealt.mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(uid, comp)`` of every linked node: smallest uid of its component, by large and small stars."""
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def facts(e):
        r = e.agg(F.count("*").alias("c"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["c"], r["h"]

    seen = facts(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = staged(small, "edges")
        now = facts(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("uid"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("uid"), F.col("v").alias("comp")).distinct())


def _blocks(members: DataFrame, weight: str, per_block: int, item: str) -> DataFrame:
    """Pairs of blocks to compare in each hub's group: strays of one block against members of another.

    ``members(hub, uid, own, stray, <weight>, <item>)``; a block holds about ``per_block`` of the weight.
    """
    sizes = members.groupBy("hub").agg(F.ceil(F.sum(weight) / per_block).cast("int").alias("blocks"))
    # one column for hub and part, so that a large group is dealt by its blocks and not by its hub
    place = F.struct("hub", F.pmod(F.hash("uid"), F.col("blocks")).cast("int").alias("part"))
    placed = members.join(sizes, "hub").select(place.alias("cell"), "stray", F.struct("uid", "own", item).alias("one"))
    blocks = placed.groupBy("cell").agg(F.collect_list("one").alias("m")).select("cell.hub", "cell.part", "m")
    strays = placed.filter("stray").groupBy("cell").agg(F.collect_list("one").alias("s")).select("cell.hub", F.col("cell.part").alias("upart"), "s")
    return strays.join(blocks, "hub")


def _promising(groups: DataFrame, floor: float, parts: int) -> DataFrame:
    """``(hub, uid)`` of members with a likely partner outside their own component, going by packed bits."""
    met = _blocks(groups.withColumn("each", F.lit(1)), "each", BLOCK, "sig").repartition(parts, F.xxhash64("hub", "upart", "part"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for hub, s, m in zip(batch.column("hub").to_pylist(), batch.column("s").to_pylist(), batch.column("m").to_pylist()):
                ids, owns, bits = np.array([x["uid"] for x in m]), np.array([x["own"] for x in m]), unpack_bits([x["sig"] for x in m])
                chosen = set()
                for x, row in zip(s, unpack_bits([x["sig"] for x in s])):
                    good = ids[(estimate(row, bits) >= floor) & (owns != x["own"])]
                    if len(good):
                        chosen.add(x["uid"])
                        chosen.update(good.tolist())
                if chosen:
                    yield pa.RecordBatch.from_arrays([pa.array([hub] * len(chosen), pa.int64()), pa.array(sorted(chosen), pa.int64())], names=["hub", "uid"])

    return met.select("hub", "s", "m").mapInArrow(run, "hub long, uid long").distinct()


def _cross_links(groups: DataFrame, hundred: int, parts: int) -> DataFrame:
    """Links across components inside each hub's group, on full sets; of a pair of blocks a spanning forest is enough."""
    met = _blocks(groups, "n", BLOCK_SHINGLES, "found").repartition(parts, F.xxhash64("hub", "upart", "part"))

    def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Sizes of all intersections, by way of the shingles that both blocks have."""
        one, two = np.concatenate(a), np.concatenate(b)
        common = np.intersect1d(one, two)
        out = np.zeros((len(a), len(b)), np.int64)
        rows = [np.searchsorted(common, x[np.isin(x, common, assume_unique=True)]) for x in a]
        columns = [np.searchsorted(common, x[np.isin(x, common, assume_unique=True)]) for x in b]
        for at in range(0, len(common), 4096):
            left, right = (np.zeros((len(x), min(4096, len(common) - at)), np.float32) for x in (a, b))
            for table, places in ((left, rows), (right, columns)):
                for k, p in enumerate(places):
                    table[k, p[(p >= at) & (p < at + 4096)] - at] = 1
            out += (left @ right.T).astype(np.int64)
        return out

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s, m in zip(batch.column("s").to_pylist(), batch.column("m").to_pylist()):
                a, b = ([np.frombuffer(x["found"], np.uint64) for x in part] for part in (s, m))
                both = shared_counts(a, b)
                na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
                near = 100 * both >= hundred * (na[:, None] + nb[None, :] - both)
                near &= np.array([x["own"] for x in s])[:, None] != np.array([x["own"] for x in m])[None, :]
                above: dict[int, int] = {}

                def top(x):
                    while above.setdefault(x, x) != x:
                        above[x] = above[above[x]]
                        x = above[x]
                    return x

                out = []
                for i, j in np.argwhere(near).tolist():
                    x, y = top(s[i]["own"]), top(m[j]["own"])
                    if x != y:
                        above[x] = y
                        out.append((s[i]["uid"], m[j]["uid"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return met.select("s", "m").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, sigs: DataFrame, floor: float) -> DataFrame:
    """Pairs whose packed bits do not rule them out."""
    with_bits = pairs.join(sigs.select(F.col("uid").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("uid").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            keep = estimate(unpack_bits(batch.column("sa").to_pylist()), unpack_bits(batch.column("sb").to_pylist())) >= floor
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return with_bits.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables joined by ``uid``: the rows of ``docs``, and ``n_shingles, component_id`` and ``first`` (this row stands for its component)."""
    spark = ready(docs.sparkSession)
    base = staged(signatures(docs, width, text_col), "signatures")
    text, hundred = F.col(f"row.{text_col}"), round(threshold * 100)
    narrow = base.select("uid", F.col(f"row.{id_col}").alias("doc_id"), "n", "k1", "k2")
    total = base.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts, floor = pieces_for(spark, total, PART_BYTES), floor_of(threshold)
    # one node per distinct set
    name = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "uid")
    sets = staged(narrow.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("uid").alias("node"), F.min(name).alias("name")), "distinct")
    nodes = sets.select(F.col("node").alias("uid"))
    texts = base.select("uid", text.alias("text"))
    bands = staged(base.select("uid", "n", "bands", "sig").join(nodes, "uid", "left_semi"), "bands")
    sigs = bands.select("uid", "n", "sig")
    members = bands.select("uid", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("uid").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    # the buckets of one hub are one group; every pair that shares a bucket is in its hub's group
    pairs = staged(members.join(shared, "bucket").filter("uid <> hub").select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct(), "pairs")
    links = staged(confirm(staged(_likely(pairs, sigs, floor), "likely"), texts, width, hundred, parts), "links")
    comps = staged(components(links), "components")
    # members outside their hub's component meet the rest of the group
    groups = pairs.select(F.col("a").alias("hub"), F.col("b").alias("uid")).join(comps, "uid", "left").withColumn("own", F.coalesce("comp", "uid")).drop("comp")
    groups = groups.join(comps.select(F.col("uid").alias("hub"), F.col("comp").alias("hub_own")), "hub", "left")
    groups = staged(groups.withColumn("stray", F.col("own") != F.coalesce("hub_own", "hub")).drop("hub_own"), "groups")
    still = groups.groupBy("hub").agg(F.count("*").alias("size"), F.max("stray").alias("any")).filter("size > 1 and any").select("hub")
    groups = groups.join(still, "hub", "left_semi").join(sigs, "uid")
    chosen = staged(groups.join(staged(_promising(groups, floor, parts), "promising"), ["hub", "uid"], "left_semi").drop("sig"), "chosen")
    if not chosen.isEmpty():
        found = whole_sets(texts, chosen.select("uid"), width)
        more = staged(_cross_links(chosen.join(found, "uid"), hundred, parts), "more-links")
        comps = staged(components(links.unionByName(more)), "components")
    labelled = sets.join(comps.withColumnRenamed("uid", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = labelled.groupBy("comp").agg(F.min("name").alias("best"))
    final = staged(labelled.join(names, "comp").select("k1", "k2", "n", F.col("best.doc_id").alias("component_id"), F.col("best.uid").alias("keeper")), "names")
    decided = narrow.join(final, ["k1", "k2", "n"], "left").select(
        "uid", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n") == 0) | (F.col("keeper") == F.col("uid"))).alias("first"),
    )
    return base, decided


def classes(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, first`` for every row of ``docs``."""
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base, decided = near_duplicates(held, width, threshold)
    return decided.join(base.select("uid", F.col("row.doc_id").alias("doc_id")), "uid").select("doc_id", "n_shingles", "component_id", "first")


def keep_first(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each component."""
    base, decided = near_duplicates(docs, width, threshold, id_col, text_col)
    return base.select("uid", "row").join(decided.filter("first").select("uid"), "uid", "left_semi").select("row.*")
