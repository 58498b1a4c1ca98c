"""Each operator on texts against a plain brute-force version."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontam, digest, langid, minhash, packing, pii, sharding, suffixes

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def collected(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# packing


def test_pack_is_a_cut_of_all_documents(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    pieces = packing.pack(docs, VOCABULARY, 64).collect()
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids) + (0,)) for i, x in texts)
    pieces.sort(key=lambda p: (p["sequence_id"], p["offset"]))
    place, runs, now = 0, Counter(), []
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), "<u4")
        assert (p["sequence_id"], p["offset"]) == divmod(place, 64) and p["length"] == len(ids) > 0
        assert p["start"] == len(now)
        place += len(ids)
        now += ids.tolist()
        if len(now) == p["doc_tokens"]:
            runs[p["doc_id"], tuple(now)] += 1
            now = []
    assert runs == want and not now


def test_windows_hold_all_tokens(docs):
    pieces = packing.pack(docs, VOCABULARY, 64).cache()
    made = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in packing.windows(pieces, 64).collect()}
    assert sorted(made) == list(range(len(made))) and {len(x) for x in made.values()} == {64}
    for p in pieces.collect():
        assert (made[p["sequence_id"]][p["offset"] : p["offset"] + p["length"]] == np.frombuffer(bytes(p["ids"]), "<u4")).all()


def test_special_strings_and_rare_characters():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    for text in ("a <|endoftext|> b", "漢字 と", "\U0001f600 x", "é" * 9, "it's  we'll\n\n x", "word " * 400_000):
        assert packing.encoder(VOCABULARY)(text).tolist() == t.encode(text, add_special_tokens=False).ids


# substring removal


def removed(rows, width):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - width + 1):
                s = b[k : k + width]
                first[s] = min(first.get(s, i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for k in range(len(b) - width + 1):
                if first[b[k : k + width]] < i:
                    gone[k : k + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1)
        out[i, len(b), len(b) - len(kept), len(edges), kept] += 1
    return out


def test_suffixes_remove_what_brute_force_removes(docs, texts):
    got = suffixes.remove_repeats(docs, 50).collect()
    assert Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in got) == removed(texts, 50)


def test_a_gram_with_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 600)
    line = "the one line that every document has in it, word for word "
    rows = [(k, f"{k * 7919 % 1000:04d}" * 9 + line + f"{k * 104729 % 997:04d}" * (k % 5 + 1)) for k in range(60)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 50).collect()
    assert Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in got) == removed(rows, 50)


@pytest.mark.parametrize("ids", [(2, 20), (20, 2)])
def test_a_document_that_repeats_a_passage_another_batch_has(spark, monkeypatch, ids):
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 600)
    passage = " ".join(f"{k * 7907 % 10007:05d} {k * 31 % 997}" for k in range(60))
    many = "".join(f"{k * 7919 % 1000:04d}" * 3 + passage for k in range(20))
    rows = [(ids[0], "before " + passage + "between " + passage + "after"), (ids[1], many)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    got = suffixes.remove_repeats(docs, 50).collect()
    assert Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in got) == removed(rows, 50)


# decontamination


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def test_decontamination(spark, docs, texts):
    items = [("b1", texts[0][1]), ("b2", "Tarimo X! " + " ".join((texts[54][1] or "").split()[25:55])), ("short", "CHANGED"), ("empty", ""), ("null", None), ("b1", texts[3][1])]
    tests = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for item, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(item)
    want = Counter()
    for i, t in texts:
        w, hit, who = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    who |= windows[tuple(w[k : k + n])]
        want[i, len(w), len(hit), tuple(sorted(who))] += 1
    found = decontam.scan(docs, tests)
    assert Counter((r["row"]["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect()) == want
    assert sum(n for (_, _, h, _), n in want.items() if h) > 5
    kept = decontam.remove_documents(docs, tests)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for (_, w, h, _), n in want.items() if not (h and 20 * h >= w))
    cut = decontam.remove_spans(docs, tests)
    assert cut.columns == docs.columns and decontam.scan(cut.filter("doc_id < 130"), tests.filter("item_id <> 'short'")).filter("n_hit > 0").count() == 0


def test_items_without_an_id_hit(spark):
    passage = " ".join(f"word{k}" for k in range(20))
    tests = spark.createDataFrame([(None, passage), ("named", "other words that have a name")], "item_id string, text string")
    texts = spark.createDataFrame([(1, "before " + passage + " after"), (2, "other words that have a name"), (3, "clean")], "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_hit"], r["items"], len(r["spans"])) for r in decontam.scan(texts, tests).collect()}
    assert got == {1: (22, 20, [], 1), 2: (6, 6, ["named"], 1), 3: (1, 0, [], 0)}
    assert [r["doc_id"] for r in decontam.remove_documents(texts, tests).collect()] == [3]


def test_decontamination_refuses_large_benchmarks(spark, docs):
    with pytest.raises(ValueError):
        decontam.scan(docs, spark.createDataFrame([("a", "b c")], "item_id string, text string"), limit_bytes=1)


# fingerprints


def test_fingerprints(docs, texts):
    got = digest.edited_neighbours(docs).collect()
    order = sorted((t for t in texts), key=lambda x: (x[0] is None, x[0] or 0))
    assert len(got) == len(order)
    unique = [i for i, n in Counter(i for i, _ in order).items() if n == 1 and i is not None]
    after = {i: order[(k + 1) % len(order)] for k, (i, _) in enumerate(order)}
    by = {r["doc_id"]: r for r in got}
    for i in unique:
        t, (next_id, nxt) = dict(texts)[i] or "", after[i]
        if next_id not in unique:
            continue
        nxt = nxt or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        r = by[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == digest.digest(t.encode()) and r["edited_fingerprint"] == digest.digest(edited.encode())
        assert r["near_next"] == digest.likeness(r["fingerprint"], digest.digest(nxt.encode()))


def test_digest_counts_whole_texts(monkeypatch):
    text = ("the quick brown fox " * 400).encode()
    whole = digest.triplet_counts(text)
    monkeypatch.setattr(digest, "PIECE", 777)
    assert (digest.triplet_counts(text) == whole).all() and whole.sum() == 6 * len(text)
    assert digest.likeness(digest.digest(b""), digest.digest(b"")) == 1.0
    assert 0 <= digest.likeness(digest.digest(b"a"), digest.digest(text)) < 0.7


# near duplicates


def shingles(t, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    above = list(range(len(sets)))

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                above[find(a)] = find(b)
    names = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            names[find(k)] = min(names.get(find(k), i), i)
    return [(i, len(s), names.get(find(k), i)) for k, (i, s) in enumerate(sets)], len({find(k) for k in range(len(sets))})


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, texts, width):
    want, groups = brute_components(texts, width)
    assert Counter(collected(minhash.classes(docs, width), "doc_id", "n_shingles", "component_id")) == Counter(want)
    kept = minhash.keep_first(docs, width)
    assert kept.columns == docs.columns and kept.count() == groups


def test_a_chain_of_near_copies(spark):
    """Neighbours are linked, the ends are not: one component all the same, whatever member is the hub."""
    words_ = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(30):
        rows.append(((k * 11) % 30, " ".join([f"n{j}" for j in range(k * 3)] + words_[k * 3 :] if k < 33 else words_)))
    want, _ = brute_components(rows, 4)
    assert Counter(collected(minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4), "doc_id", "n_shingles", "component_id")) == Counter(want)
    assert len({c for _, _, c in want}) < 30


def test_copies_of_a_missing_middle(spark):
    """Every copy is near the original but few are near each other: the original is found though it is not the hub."""
    import random

    import random

    rng = random.Random(3)
    original = [f"w{k}" for k in range(300)]
    rows = [(999, " ".join(original))]
    for k in range(40):
        w = list(original)
        for at in rng.sample(range(300), 8):
            w[at] = f"x{k}y{at}"
        rows.append((k, " ".join(w)))
    want, groups = brute_components(rows, 4)
    assert groups < 10
    assert Counter(collected(minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4), "doc_id", "n_shingles", "component_id")) == Counter(want)


def test_estimate_takes_chance_out():
    rng = np.random.default_rng(1)
    x = rng.choice(1 << 60, 4000, replace=False).astype(np.uint64)
    a, b = minhash.minima(x[:3000]), minhash.minima(x[1000:])
    bits = minhash.unpack_bits([minhash.pack_bits(a), minhash.pack_bits(b)])
    assert (bits[0] == np.concatenate([(a & 15)[::2], (a & 15)[1::2]])).all()
    assert abs(minhash.estimate(bits[0], bits[1]) - 0.5) < 0.15


# language


def test_language(spark):
    import random

    rng = random.Random(2)
    kinds = {"aa": "ta ri mo len", "bb": "ske vu pra ni", "cc": "été ñu öl shu"}
    rows = []
    for k in range(240):
        lang = ("aa", "bb", "cc")[k % 3]
        rows.append((k, " ".join("".join(rng.choice(kinds[lang].split()) for _ in range(3)) for _ in range(rng.randint(2, 40))), lang))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !!", "cc"), (903, rows[0][1], None), (904, "tarimo " * 300_000, None), (0, rows[0][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter(langid.fold() != 0))
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r["row"]["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == by[k]["row"]["lang"] and not by[k]["rejected"] and 0.3 < by[k]["score"] <= 1 for k in range(240))
    assert [by[k]["lang_pred"] for k in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "aa"] and by[902]["rejected"] and by[902]["score"] == 0
    strange = langid.identify(spark.createDataFrame([(1, "qqxz zzkq wwjj " * 20)], "doc_id long, text string"), model).first()
    assert strange["rejected"]


def test_every_language_has_a_limit(spark):
    import random

    rng = random.Random(3)
    word = lambda parts: "".join(rng.choice(parts.split()) for _ in range(3))
    rows = [(" ".join(word(p) for _ in range(rng.randint(5, 40))), lang) for lang, p in (("aa", "ta ri mo len"), ("bb", "ske vu pra ni")) for _ in range(200)]
    rows += [("qzxw jqkz wqxj zwkq", "dd"), ("", "ee")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    model = langid.fit(df)
    assert set(model.limits) == set(model.langs) == {"aa", "bb", "dd"}
    h = {lang: [-s[k] / n for s, n in zip(*model.score([t for t, x in rows if x == lang]))] for k, lang in enumerate(model.langs)}
    n = {lang: model.score([t for t, x in rows if x == lang])[1] for lang in model.langs}
    for lang in ("aa", "bb"):
        mean, squares = np.average(h[lang], weights=n[lang]), (np.array(h[lang]) - np.average(h[lang], weights=n[lang])) ** 2
        slope = max(0.0, np.cov(1 / n[lang], squares)[0, 1] / np.var(1 / n[lang], ddof=1))
        assert np.allclose(model.limits[lang], (mean, max(squares.mean() - slope * (1 / n[lang]).mean(), langid.LEAST_SPREAD), slope), rtol=1e-6, atol=1e-9)
    found = model.decide(["qgzf xcwb jdkh zyqg " * 20, rows[-2][0], rows[0][0]])
    assert [(f[0], f[3]) for f in found] == [("dd", True), ("dd", False), ("aa", False)]


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    code = rng.integers(0, 1 << 24, 3000) & 0x0C30C3
    keys, counts = np.unique(code, return_counts=True)
    high, low, back = langid.kneser_ney(keys, counts)
    assert np.allclose(low.reshape(-1, 64).sum(axis=1), 1)
    context = keys[0] >> 6
    own = keys >> 6 == context
    rest = np.ones(64, bool)
    rest[keys[own] & 63] = False
    assert np.isclose(high[own].sum() + back[context] * low.reshape(-1, 64)[context & 4095][rest].sum(), 1)


def test_language_without_labels(docs):
    model = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}


# personal data

SAMPLES = [
    "mail a.b+c@x-y.example.com, then 10.0.0.255 and 256.1.1.1 or 1.2.3.4.5.6.7.8 end",
    "card 4111 1111 1111 1111 and 4111111111111112; +1 (171) 555-2028 or +12 or +1234567890123456",
    "a@b@c.d x@y.z_q@w.org x@y.com.z@w.org .@a.b @a.b a@b a@b..c",
    "é\U0001f600 4012-8888-8888-1881 4 0 1 2 8 8 8 8 8 8 8 8 1 8 8 1  5",
    'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" call 555-123-4567 or John Smith',
    "4111111111111111" * 3, "a" * 3000 + "@", "1" * 4000, "1." * 3000, "+1" + " " * 3000, "x@a" + ".b" * 3000, "a@b.c " * 700, "- 1" * 3000, None, "", "nothing here",
]


def base_spans(t):
    def luhn(d):
        return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (True, k == 1 and all(int(x) < 256 for x in m.group().split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(SAMPLES)] + [(None, SAMPLES[0])], "doc_id long, text string")
    for r in pii.detect(df, ["doc_id", "text"]).collect():
        assert [tuple(s) for s in r["base"]] == base_spans(r["row"]["text"])
        for a in r["added"]:
            assert all(a["end"] <= b["start"] or b["end"] <= a["start"] for b in r["base"])


def test_redaction(spark, docs):
    df = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" to x.y@mail.example.com or +1 (171) 555-2028!")))
    out = pii.redact(df)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert r["text"].endswith(" to [EMAIL] or [PHONE]!") and r["n_chars"] == len(r["text"])


def test_reliabilities_follow_agreement():
    likely = pii.reliabilities({(5, "+++++"): 50, (5, "++0++"): 40, (5, "-0-0-"): 60, (5, "---0-"): 40, (5, "+0000"): 5})
    assert likely[5, "+++++"] > 0.95 and likely[5, "---0-"] < 0.05


# sharding


def test_shards_are_level_and_gapless(docs, texts):
    rows = sharding.shard(docs, shards=5, dimensions=("lang", "n_chars", "source")).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for s in range(5):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_shards_near_equal_and_copies_together(spark):
    rows = [(k, f"text number {k // 2} " * 5, "en" if k % 4 < 2 else "fr", 100) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = sharding.shard(df, shards=16).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.04 * sum(sizes.values()) / 16
    places = {}
    for r in got:
        places.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert max(map(len, places.values())) == 1
    by_target = sharding.shard(df, target_bytes=20_000)
    assert by_target.groupBy("shard").sum("size").agg(F.max("sum(size)")).first()[0] < 21_500


def test_one_text_for_all_is_split(spark):
    got = sharding.shard(spark.range(1000).selectExpr("id as doc_id", "'same' as text", "'en' as lang", "4L as n_chars"), shards=4)
    assert all(abs(r["count"] - 250) <= 2 for r in got.groupBy("shard").count().collect())


# empty tables


def test_empty_tables(spark, none):
    tests = spark.createDataFrame([("a", "b c d")], "item_id string, text string")
    model = langid.fit(none)
    for df in (
        packing.pack(none, VOCABULARY), packing.windows(packing.pack(none, VOCABULARY)), suffixes.remove_repeats(none), decontam.scan(none, tests), decontam.remove_spans(none, tests), digest.fingerprints(none),
        digest.edited_neighbours(none), minhash.classes(none), minhash.keep_first(none), langid.identify(none, model), pii.detect(none, ["doc_id"]), pii.redact(none), sharding.shard(none, shards=3), sharding.shard(none, target_bytes=10),
    ):
        assert df.count() == 0
    full = spark.createDataFrame([(1, "b c d e")], "doc_id long, text string")
    assert decontam.scan(full, tests.limit(0)).first()["n_hit"] == 0
