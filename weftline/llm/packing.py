"""Concatenate and cut: documents become windows of a fixed number of tokens.

Pass one tokenises every document and adds up tokens per partition; a prefix sum over the
partition totals gives each document its place in one endless run of tokens.  Pass two cuts that
run into windows.  A document that crosses a window's border leaves one record per window.

Defined results: a null or empty text is its end token alone; a null id stays null; repeated rows
are packed one after the other; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import ready, staged

PIECE_CHARS = 1 << 20
OUT_BYTES = 4 << 20
BROADCAST_PARTS = 1 << 20
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def encoder(path: str):
    """Text to ids as ``tokenizers`` gives them for the vocabulary file at ``path``.

    Where a rank file of the same vocabulary lies beside it, text below U+3000 without special
    strings goes through ``tiktoken``: the same ids at a third of the time.
    """
    import base64
    import os

    import regex

    ranks, fast = path.removesuffix(".json") + ".tiktoken", None
    if path.endswith(".json") and os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    rare = regex.compile("[^\x00-\u2fff]")

    def encode(text: str) -> np.ndarray:
        if fast is None or SPECIAL in text or not text.isascii() and rare.search(text):
            return np.asarray(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
        parts = [np.asarray(fast.encode_to_numpy(p, disallowed_special=()), np.uint32) for p in pretoken_pieces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    return encode


def pretoken_pieces(text: str) -> Iterator[str]:
    """Cut a very long text where a lone space follows a letter: a token never crosses that place."""
    start, n = 0, len(text)
    while n - start > PIECE_CHARS:
        at = start + PIECE_CHARS
        while at < n and not (text[at] == " " and text[at - 1].isalpha() and at + 1 < n and text[at + 1].isalpha()):
            at += 1
        yield text[start:at]
        start = at
    if start < n or start == 0:
        yield text[start:]


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """``(doc_id, part, at, n, ids)``: ids as little-endian unsigned 32-bit words, ``at`` counts within the task."""
    keep = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {keep.schema['doc_id'].dataType.simpleString()}, part int, at long, n long, ids binary"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, at = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        for batch in batches:
            ids_of, starts, lengths, blobs, size, first = batch.column("doc_id"), [], [], [], 0, 0

            def out(upto):
                return pa.RecordBatch.from_arrays(
                    [ids_of.slice(first, upto - first), pa.array([part] * (upto - first), pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["doc_id", "part", "at", "n", "ids"],
                )

            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                ids = np.concatenate([encode(text).astype("<u4"), end]) if text else end
                starts.append(at)
                lengths.append(len(ids))
                blobs.append(ids.tobytes())
                at += len(ids)
                size += len(blobs[-1])
                if size >= OUT_BYTES:
                    yield out(k + 1)
                    starts, lengths, blobs, size, first = [], [], [], 0, k + 1
            if blobs:
                yield out(batch.num_rows)

    return keep.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    Documents follow each other in the order of the input's partitions, so no text is shuffled.
    Only the per-partition totals, one row each, meet in one place.
    """
    ready(docs.sparkSession)
    rows = staged(tokenised(docs, path, id_col, text_col, end_id), "tokens")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    bases = totals.select(
        "part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    # one small row per task of pass one: counted, and sent along while they stay few
    few = totals.count() <= BROADCAST_PARTS
    placed = rows.join(F.broadcast(bases) if few else bases, "part").withColumn("place", F.col("base") + F.col("at"))
    window = F.explode(F.sequence(F.expr(f"place div {length}"), F.expr(f"(place + n - 1) div {length}")))
    cut = placed.select("doc_id", "place", "n", "ids", window.alias("sequence_id"))
    low = F.col("sequence_id") * length
    cut = cut.withColumn("start", F.greatest(F.lit(0), low - F.col("place"))).withColumn(
        "length", F.least(F.col("n"), low + length - F.col("place")) - F.col("start")
    )
    return cut.select(
        "doc_id",
        "start",
        "length",
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        F.greatest(F.lit(0), F.col("place") - low).alias("offset"),
        F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids"),
    )


def windows(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, n, ids)``: whole windows; the last one is padded to ``length``.

    A piece that fills its window is done.  The others are boundary records: at most ``length``
    of them meet per window.
    """
    whole = pieces.filter(F.col("length") == length).select("sequence_id", F.col("length").alias("n"), "ids")
    ends = pieces.filter(F.col("length") < length).groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    pad = F.unhex(F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({length} - n as int))"))
    return whole.unionByName(ends.select("sequence_id", "n", F.concat(joined, pad).alias("ids")))
