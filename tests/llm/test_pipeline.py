"""The pipeline's stages on a small table, and the registered names."""

import os

import corpus_pipeline
from pyspark.sql import functions as F
from test_text_operators import brute_components, plain_words

from weftline.llm import queries as q
from weftline.llm.common import release

SF = os.environ.get("WEFTLINE_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before = seen.select("doc_id", "text").collect()
        stage(spark, seen, SF).write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in seen.collect()}
        if name != "packing":
            assert seen.columns == docs.columns
        if name == "language":
            assert set(after) == {r["doc_id"] for r in before if r["text"]}
        elif name == "near_duplicates":
            want, _ = brute_components([(r["doc_id"], r["text"]) for r in before], 5)
            assert set(after) == {c for _, _, c in want}
        elif name == "decontamination":
            windows = set()
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = plain_words(r["text"])
                windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))}
            keep = set()
            for r in before:
                w, hit = plain_words(r["text"]), set()
                for n in {len(x) for x in windows}:
                    for k in range(len(w) - n + 1):
                        if tuple(w[k : k + n]) in windows:
                            hit |= set(range(k, k + n))
                if not (hit and 20 * len(hit) >= len(w)):
                    keep.add(r["doc_id"])
            assert set(after) == keep
        elif name == "personal_data":
            assert set(after) == {r["doc_id"] for r in before}
            assert all("@mail" not in r["text"] for r in after.values())
        else:
            assert {r["doc_id"] for r in before} == set(after)
    release(spark)


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {n for n in q.QUERIES if n.startswith("op")} <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 11))


def test_stages_on_odd_rows(spark, docs, none, texts, tmp_path):
    """Nulls, empties, repeats, very long texts and clashing names pass through every stage; so does an empty table."""
    odd = docs.withColumn("a.b", F.lit(None).cast("double")).withColumn("spans", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("text_", F.array(F.lit(1)))
    for label, seen in (("full", odd), ("empty", odd.limit(0))):
        columns = seen.columns
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, seen, SF).write.parquet(str(tmp_path / label / name))
            seen = spark.read.parquet(str(tmp_path / label / name))
            if name != "packing":
                assert seen.columns == columns
            if label == "full" and name == "language":
                lettered = [t for _, t in texts if t and any(c.isalpha() for c in t)]
                assert 0 < seen.count() <= len(lettered) and seen.filter("text is null or text = ''").isEmpty()
        assert (seen.count() == 0) == (label == "empty")
    release(spark)
