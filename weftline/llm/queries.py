"""The registered queries: one per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, digest, langid, merkle, minhash, oracles, packing, pii, quotes, sharding, simhash, suffixes, trie, urlfilter

VOCABULARY = "byte_bpe_50k.json"
URL_RULES = [
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
]
# for what no host rule decides: places that serve advertisements or betting
URL_PATTERNS = [
    urlfilter.Rule("block", pattern=r"\A(?:ads?|adserver|banners?|track(?:er|ing)?)[0-9]*\."),
    urlfilter.Rule("block", pattern=r"(?:\A|[.-])(?:casino|betting|porn|xxx)[0-9]*[.-]"),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), vocabulary_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "row.doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.BASE)],
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.judge(pages, URL_RULES + URL_PATTERNS)
    named = F.col("rule").isin([r.name for r in URL_RULES])
    return judged.select("row.page_id", "host", "path", F.when(named, F.col("rule")).alias("rule"), "verdict")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(read(spark, sf_dir, "documents"), width=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.is_contaminated().alias("contaminated"),
    )


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_neighbours(read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(read(spark, sf_dir, "documents"), width=4, threshold=0.8)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(langid.fold() != 0))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", (langid.fold("row.doc_id") == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.link(read(spark, sf_dir, "conversations"))
    return found.select("row.conv_id", "row.turn", "row.role", "own", "n_passages", "n_linked", "parent_turn", "order_key")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(fields(lower)))
    rows = merkle.manifest(docs, merkle.leaf(fields(F.col("text"))), "source", "doc_id", {"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("siblings"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("siblings")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = trie.turns(read(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.with_shared_heads(own, every=100, most=6))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_personal_data": op2_personal_data,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_fingerprint": op6_fingerprint,
    "op7_sharding": op7_sharding,
    "op8_minhash": op8_minhash,
    "op9_language": op9_language,
    "op10_quotation": op10_quotation,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_simhash": op13_simhash,
}
ORACLES = oracles.ORACLES
