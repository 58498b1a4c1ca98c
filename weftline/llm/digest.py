"""Quartile bucket digests: locality-sensitive fingerprints of whole texts.

Every five-byte window gives six byte triplets; each is hashed into one of 512 buckets.  The digest
holds, per bucket, which quartile of the counts it falls into (two bits), and the length on a
logarithmic scale.  Two digests differ by a bounded sum of bucket and length steps.

Defined results: a null text is an empty one; equal texts have equal digests; a text of a few bytes
still fills buckets, as windows reach over its start; a text of any length is counted in pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import mix64, pieces_for, ready, staged, with_row

BUCKETS = 512
PIECE = 1 << 20
PART_BYTES = 16 << 20
#: Mean cost of two unrelated buckets: steps of 0, 1, 2 and 3 quartiles cost 0, 1, 2 and 6.
COST = np.array([0, 1, 2, 6])
UNRELATED = 26 / 16
#: Pairs of older bytes that form a triplet with the newest byte of a window.
PAIRS = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))
TABLES = (mix64(np.arange(13 * 256, dtype=np.uint64) + np.uint64(7)) >> np.uint64(55)).astype(np.uint16).reshape(13, 256)


def triplet_counts(raw: bytes) -> np.ndarray:
    """How often each bucket is hit by the triplets of all five-byte windows."""
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(raw), PIECE):
        piece = np.frombuffer(raw[max(0, start - 4) : start + PIECE], np.uint8)
        if start < 4:
            piece = np.concatenate([np.zeros(4 - start, np.uint8), piece])
        n = len(piece) - 4
        newest = TABLES[0][piece[4:]]
        for k, (a, b) in enumerate(PAIRS):
            hit = newest ^ TABLES[1 + 2 * k][piece[4 - a : 4 - a + n]] ^ TABLES[2 + 2 * k][piece[4 - b : 4 - b + n]]
            counts += np.bincount(hit, minlength=BUCKETS)
    return counts


def length_code(n: int) -> int:
    """Length in eighths of a power of two, at most 255."""
    return min(255, int(round(8 * np.log2(n + 1))))


def digest(raw: bytes) -> str:
    """Two hexadecimal digits of length, then two bits for each bucket."""
    counts = triplet_counts(raw)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return f"{length_code(len(raw)):02x}" + packed.astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from the distance of unrelated buckets on."""
    if a == b:
        return 1.0
    codes = [np.unpackbits(np.frombuffer(bytes.fromhex(x[2:]), np.uint8)).reshape(-1, 2) @ np.array([2, 1]) for x in (a, b)]
    length = min(abs(int(a[:2], 16) - int(b[:2], 16)), 64)
    cost = COST[np.abs(codes[0] - codes[1])].sum() + length
    return float(max(0.0, 1.0 - cost / (UNRELATED * BUCKETS)))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in ``row``, and ``fingerprint``; nothing is shuffled."""
    ready(docs.sparkSession)
    held = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [digest((t.as_py() or "").encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.string())], names=["row", "fingerprint"])

    return held.mapInArrow(run, with_row(held, "fingerprint string"))


def _edit(text: str, after: str) -> str:
    m = len(text) // 4
    return text[: len(text) - m] + after[:m]


def _result(doc_id, text: str, own: str, after: str, next_print: str) -> tuple:
    edited = _edit(text, after)
    raw = edited.encode()
    print_ = own if edited == text else digest(raw)
    return doc_id, len(text), hashlib.sha256(raw).hexdigest(), own, print_, likeness(own, print_), likeness(own, next_print)


FIELDS = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against itself with its last quarter taken from the next document.

    Documents are range-partitioned by id; a task sees neighbours one after the other.  Only the
    first and last text of each partition are joined across partitions.  Null ids come last;
    repeated ids are ordered by their text's hash.
    """
    spark = ready(docs.sparkSession)
    held = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    placed = held.repartitionByRange(pieces_for(spark, total, PART_BYTES), *order).sortWithinPartitions(*order)
    kind = held.schema["doc_id"].dataType.simpleString()
    schema = FIELDS.format(id=kind) + ", part int, head string, tail string, tail_id " + kind

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, names = TaskContext.get().partitionId(), ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "head", "tail", "tail_id"]
        id_type, first, last = None, None, None

        def rows(out):
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string(), id_type]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            id_type, out = batch.schema.field("doc_id").type, []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                own = digest(text.encode())
                if last is None:
                    first = text
                else:
                    out.append((*_result(*last, text, own), part, None, None, None))
                last = (doc_id, text, own)
            if out:
                yield rows(out)
        if last is not None:
            yield rows([(None, None, None, None, None, None, None, part, first, last[1], last[0])])

    made = staged(placed.mapInArrow(run, schema), "digests")
    done = made.filter("head is null").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    ends = made.filter("head is not null")
    parts = ends.select("part")
    follow = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next_part"))
    pairs = (
        ends.select("part", "tail_id", "tail").join(follow, "part")
        .join(ends.select(F.col("part").alias("next_part"), "head"), "next_part")
        .select(F.col("tail_id").alias("doc_id"), "tail", "head")
    )

    def close(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, tail, head in zip(batch.column("doc_id").to_pylist(), batch.column("tail").to_pylist(), batch.column("head").to_pylist()):
                out.append(_result(doc_id, tail, digest(tail.encode()), head, digest(head.encode())))
            if out:
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return done.unionByName(pairs.mapInArrow(close, FIELDS.format(id=kind)))
