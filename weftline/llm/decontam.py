"""Benchmark decontamination: a broadcast hash set of test windows meets every training window.

Words are lower-cased runs of letters, digits and non-ASCII characters.  A test item gives every
run of ``width`` words; a shorter item gives itself.  Each training document is scanned once, in
place: hashes select windows, the words themselves confirm them.  No shuffle.

Defined results: null and empty texts have no words and no hits; items without words give no
window; repeated items each count; an item without an id hits like any other and is not named; an empty test table hits nothing; the words of a text are never
cut short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import flat_bytes, ready, staged, window_hashes, with_row, word_runs

LIMIT = 256 << 20
PER_WINDOW = 20
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def test_windows(tests: DataFrame, width: int) -> DataFrame:
    """Per item with words: ``item``, its words joined by spaces (``block``), its window length, and each window's hash, start and end in the block.

    The last three are packed arrays of 64, 32 and 32 bits; a window that an item repeats is listed once.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                low, starts, ends, _, words = word_runs(data, np.array([0, len(data)]), WORD)
                if not len(words):
                    continue
                size = min(width, len(words))
                raw = low.tobytes()
                block = b" ".join(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
                lengths = ends - starts
                last = np.cumsum(lengths + 1) - 1
                hashes, first = np.unique(window_hashes(words, size), return_index=True)
                at, to = (last - lengths)[first], last[first + size - 1]
                out.append((item, size, block, hashes.tobytes(), at.astype(np.uint32).tobytes(), to.astype(np.uint32).tobytes()))
            if out:
                kinds = [pa.string(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["item", "size", "block", "h", "s", "e"])

    return tests.mapInArrow(run, "item string, size int, block binary, h binary, s binary, e binary")


class Windows:
    """Test windows as flat arrays sorted by hash, for each window length, over one block of all items' words."""

    def __init__(self, rows: list):
        self.names = [r["item"] for r in rows]
        self.block = b"".join(r["block"] for r in rows)
        begins = np.cumsum([0, *[len(r["block"]) for r in rows]])
        self.tables = {}
        for size in sorted({r["size"] for r in rows}):
            own = [k for k, r in enumerate(rows) if r["size"] == size]
            hashes = [np.frombuffer(rows[k]["h"], np.uint64) for k in own]
            who = np.repeat(np.array(own, np.int32), [len(h) for h in hashes])
            start, end = (np.concatenate([np.frombuffer(rows[k][c], np.uint32).astype(np.int64) + begins[k] for k in own]) for c in "se")
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            self.tables[size] = h[order], who[order], start[order], (end - start)[order].astype(np.int32)

    def holders(self, size: int, h: int, text: bytes) -> list[int]:
        """The items that have a window, word for word."""
        hashes, who, start, length = self.tables[size]
        lo, hi = np.searchsorted(hashes, np.uint64(h)), np.searchsorted(hashes, np.uint64(h), "right")
        return [int(who[k]) for k in range(lo, hi) if self.block[start[k] : start[k] + length[k]] == text]


def members(values: np.ndarray, table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of ``values`` that are in the sorted ``table``; a bit table refuses most at once."""
    maybe = np.flatnonzero(bits[values >> np.uint64(44)])
    if not len(maybe):
        return maybe
    place = np.minimum(np.searchsorted(table, values[maybe]), len(table) - 1)
    return maybe[table[place] == values[maybe]]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 13, text_col: str = "text", item_col: str = "item_id", limit_bytes: int = LIMIT) -> DataFrame:
    """All columns of ``docs`` in the struct ``row``, with ``n_words, n_hit, items`` and ``spans``.

    ``items`` are the ids (as strings, sorted) of the items that occur, ``spans`` the hit runs as
    ``[start, end)`` in UTF-8 bytes.  The items' windows are made in tasks; their words and flat arrays,
    counted before they are fetched, are broadcast, at most ``limit_bytes``.
    """
    spark = ready(docs.sparkSession)
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    made = staged(test_windows(tests, width), "test-windows")
    sized = F.octet_length("block") + F.octet_length("h") / 8 * PER_WINDOW + F.coalesce(F.octet_length("item"), F.lit(0))
    total = int(made.agg(F.sum(sized)).first()[0] or 0)
    if total > limit_bytes:
        raise ValueError(f"the benchmark's windows take {total} bytes, more than limit_bytes={limit_bytes}")
    shared = spark.sparkContext.broadcast(Windows(made.collect()))
    held = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    schema = with_row(held, "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")

    def run(batches):
        import pyarrow as pa

        tests = shared.value
        tables = {size: x[0] for size, x in tests.tables.items()}
        bits = {}
        for size, table in tables.items():
            bits[size] = np.zeros(1 << 20, bool)
            bits[size][table >> np.uint64(44)] = True
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            low, starts, ends, row, words = word_runs(data, offsets, WORD)
            count = np.bincount(row, minlength=batch.num_rows)
            cover = np.zeros(len(words) + 1, np.int64)
            items: dict[int, set] = {}
            for size, table in tables.items():
                found = members(window_hashes(words, size), table, bits[size])
                found = found[row[found] == row[found + size - 1]]
                for k in found.tolist():
                    text = b" ".join(low[a:b].tobytes() for a, b in zip(starts[k : k + size], ends[k : k + size]))
                    who = tests.holders(size, int(window_hashes(words[k : k + size], size)[0]), text)
                    if who:
                        cover[k] += 1
                        cover[k + size] -= 1
                        items.setdefault(int(row[k]), set()).update(tests.names[x] for x in who if tests.names[x] is not None)
            hit = np.cumsum(cover[:-1]) > 0
            n_hit = np.bincount(row[hit], minlength=batch.num_rows)
            spans: dict[int, list] = {}
            at = np.flatnonzero(hit)
            if len(at):
                breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(row[at]) > 0)) + 1
                for run_ in np.split(at, breaks):
                    r = int(row[run_[0]])
                    spans.setdefault(r, []).append({"start": int(starts[run_[0]] - offsets[r]), "end": int(ends[run_[-1]] - offsets[r])})
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(count, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([sorted(items.get(k, ())) for k in range(batch.num_rows)], pa.list_(pa.string())),
                    pa.array([spans.get(k, []) for k in range(batch.num_rows)], span),
                ],
                names=["row", "n_words", "n_hit", "items", "spans"],
            )

    return held.mapInArrow(run, schema)


def is_contaminated(part: int = 20):
    """The rule: some word is hit, and the hit words are at least one in ``part``."""
    return (F.col("n_hit") > 0) & (part * F.col("n_hit") >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = 13, part: int = 20) -> DataFrame:
    """The rows of ``docs`` that the rule leaves, unchanged."""
    return scan(docs, benchmark, width).filter(~is_contaminated(part)).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = 13, text_col: str = "text") -> DataFrame:
    """All rows of ``docs``; the hit runs of words are cut out of the text."""
    found = scan(docs, benchmark, width, text_col)
    raw = F.encode(F.col(f"row.{text_col}"), "UTF-8")
    # pieces between hit runs, taken on bytes: runs start and end at whole characters
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    stops = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length(F.col(f"row.{text_col}")).cast("long")))
    kept = F.aggregate(
        F.arrays_zip(starts.alias("a"), stops.alias("b")), F.lit(b""),
        lambda acc, p: F.concat(acc, F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))),
    )
    text = F.when(F.size("spans") == 0, F.col(f"row.{text_col}")).otherwise(F.decode(kept, "UTF-8"))
    return found.withColumn("row", F.col("row").withField(text_col, text)).select("row.*")
