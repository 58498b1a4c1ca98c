"""Merkle manifest, conversation trie and SimHash classes against direct computation."""

import hashlib
import math
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import common, merkle, simhash, trie

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- Merkle manifest -----------------------------------------------------------------------


def leaf_of(row, text):
    parts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def climb(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def beside(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return out


def expected(rows):
    first = lambda v: (v is not None, v)
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((first(r["doc_id"]), leaf_of(r, r["text"])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[1] for x in sorted(groups[n])]) for n in names]
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, (n, tree) in enumerate(zip(names, trees)):
        for i, (key, leaf) in enumerate(sorted(groups[n])):
            proof = beside(tree, i) + beside(top, k)
            out.append((key[1], leaf, tree[-1][0], top[-1][0], "".join(a + b for a, b in proof)))
    return out


def manifest_of(df):
    out = merkle.manifest(df, merkle.leaf([F.col(c) for c in FIELDS]))
    folded = merkle.fold(F.col("leaf"), F.col("siblings"))
    rows = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_text(F.col("siblings")).alias("proof"), (folded == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in rows)
    return [tuple(r)[:5] for r in rows]


def test_manifest_of_odd_rows(docs):
    rows = [r.asDict() for r in docs.collect()]
    assert sorted(manifest_of(docs), key=str) == sorted(expected(rows), key=str)


@pytest.mark.parametrize("sizes", [(1,), (16,), (17, 1), (256, 257), (4100, 3, 1)])
def test_manifest_sizes(spark, sizes):
    rows = [(k, f"s{g}" if g else None, "en", 2, f"t{k}") for g, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert sorted(manifest_of(df), key=str) == sorted(expected([dict(zip(FIELDS, r)) for r in rows]), key=str)


def test_manifest_with_many_groups_and_a_change(spark):
    rows = [(k, f"s{k % 300}", None, 0, "") for k in range(620)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(manifest_of(df), key=str) == sorted(expected([dict(zip(FIELDS, r)) for r in rows]), key=str)
    out = merkle.manifest(df, merkle.leaf([F.col(c) for c in FIELDS]), carry={"other": F.when(F.col("doc_id") == 77, F.sha2(F.lit("x"), 256)), "order": F.col("doc_id") * 2})
    seen = out.select("doc_id", "order", (merkle.fold(F.coalesce("other", "leaf"), F.col("siblings")) == F.col("root")).alias("ok")).collect()
    assert [r.doc_id for r in seen if not r.ok] == [77] and all(r.order == 2 * r.doc_id for r in seen)


def test_manifest_of_nothing(none):
    assert manifest_of(none) == []


# -- conversation trie ------------------------------------------------------------------------


def rebuilt_of(rows, heads):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    if not heads:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def trie_of(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) if below else 1
        saved[path] = sum(saved[k] for k in below) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    ends = {p: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)) for p, m in members.items()}
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(ends[p])) for p, m in members.items()
    )


def found_trie(spark, rows, heads):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1)).withColumn("id", F.lit("x")).repartition(4)
    own = trie.turns(df)
    out = trie.prefix_trie(trie.with_shared_heads(own, 100, 6) if heads else trie.plain(own))
    return sorted(tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 250, 399, -7, -100, 10**12]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hello", "yes", "", None, "\U0001f600 two", "no"])))
    rows += [(300, None, "user", "first of all"), (300, 0, "user", "then"), (300, 0, "user", "then"), (300, 0, "assistant", "b"), (None, 0, "user", "nobody's"), (301, 5, None, None)]
    # many with one first turn, many the same
    rows += [(1000 + k, t, "user", "one" if t < 2 else f"{k % 3}") for k in range(60) for t in range(3)]
    return rows


@pytest.mark.parametrize("heads", [False, True])
def test_trie(spark, heads):
    rows = conversations()
    assert found_trie(spark, rows, heads) == trie_of(rebuilt_of(rows, heads))


def test_trie_in_small_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_TURNS", 7)
    monkeypatch.setattr(trie, "SHARD_CONVERSATIONS", 3)
    # one conversation that holds most turns, cut by partitions and shards, and a copy of its beginning
    rows = conversations() + [(50, t, "user", f"w{t % 5}") for t in range(400)] + [(70, t, "user", f"w{t % 5}") for t in range(150)]
    assert found_trie(spark, rows, False) == trie_of(rebuilt_of(rows, False))


def test_shard_with_many_conversations():
    shard = trie.Shard()
    for c in range(1000):
        shard.open(c, (0, 0, 0), True)
        shard.add(0, 0, 0, 0, False)
        shard.add(1, 5, 6, 3, c % 2 == 0)
        if c % 2:
            shard.add(2, c, c, 1, True)
    nodes = list(shard.nodes())
    assert nodes[0][6] == 1000 and nodes[1][6] == 1000 and len(nodes) == 502
    assert len(nodes[1][8]) // 8 == 500 and nodes[1][7] == 0


def test_trie_of_nothing(spark):
    assert found_trie(spark, [(None, 1, "user", "x")], True) == []
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.plain(trie.turns(df))).count() == 0


# -- SimHash -----------------------------------------------------------------------------------


def simhash_of(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g.encode(), 42) >> bit & 1 for g in grams) > len(grams):
            out |= 1 << bit
    return out


def groups_of(items, radius):
    """Smallest id of each item's component; ``items`` are (id, fingerprint)."""
    above = list(range(len(items)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= radius:
                above[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(items):
        if d is not None:
            least[top(k)] = min(least.get(top(k), d), d)
    return sorted(((d, f"{fp:016x}", least.get(top(k))) for k, (d, fp) in enumerate(items)), key=str)


def test_fingerprints_and_classes(docs, texts):
    short = [(d, t) for d, t in texts if t is None or len(t) < 20_000]
    got = simhash.classes(docs.filter("text is null or length(text) < 20000"))
    got = sorted(((r.doc_id, r.hex, r.component_id) for r in got.select("doc_id", simhash.hex_digits(F.col("fp")).alias("hex"), "component_id").collect()), key=str)
    assert got == groups_of([(d, simhash_of(t)) for d, t in short], 3)


@pytest.mark.parametrize("tile,block", [(1 << 15, 256), (8, 4)])
def test_links_of_random_fingerprints(spark, monkeypatch, tile, block):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 6])):
            fps.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.linked(spark.createDataFrame(signed, "fp long"), 3).collect()
    above = {x: x for x in fps}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for r in links:
        above[top(r.a & (1 << 64) - 1)] = top(r.b & (1 << 64) - 1)
    want = {d: c for d, _, c in groups_of(list(enumerate(fps)), 3)}
    have = {}
    for k, x in enumerate(fps):
        have.setdefault(top(x), []).append(k)
    assert {k: min(v) for v in have.values() for k in v} == want


def test_simhash_of_nothing(none):
    assert simhash.classes(none).count() == 0


# -- helpers -----------------------------------------------------------------------------------


def test_attach_and_numbered(spark):
    left = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(300)] + [(1000, None)], "i long, key string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "key string, v long")
    got = {r.i: r.v for r in common.attach(left, right, "key").collect()}
    assert len(got) == 301 and all(got[k] == (1 if k % 3 else {0: 2, 3: 3}.get(k)) for k in range(300)) and got[1000] is None
    rows = common.numbered(left, "key", ["i"], ["i"]).collect()
    for key in {r.key for r in rows}:
        own = sorted((r.i, r.pos, r.total) for r in rows if r.key == key)
        assert [x[1] for x in own] == list(range(len(own))) and {x[2] for x in own} == {len(own)}
