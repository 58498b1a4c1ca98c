"""Exact substring removal with a logarithmic family of sparse suffix arrays.

A byte goes if a ``width``-byte string covering it also starts in a document with a smaller id.

Suffixes are sampled where the text itself says so: each window of ``width`` bytes picks the smallest
hash among its 20-byte grams, and a run of windows with one pick is a segment.  Equal strings pick
alike wherever they stand, so nothing is missed.  A batch of documents gives one sorted array of
(gram, segment) entries.  In every gram bucket the arrays join a family: a new array is merge-scanned
against the levels, the later document of two equal segments is marked, and levels of like size merge.

Grams with different segments around them may still share a window at a segment's edge.  Those segments
go back to their text, and their windows are compared one by one by a 96-bit hash.

Text, entries and spans travel as packed blocks, dealt by gram, document or window; a gram with many
segments in one batch sends one or two marks and is settled by its windows, which are dealt by their own
hash; that the gram was such a one stays known when a mark leaves the index, and all its segments elsewhere
send their windows too.

Defined results: null and empty texts have no bytes; a null id removes nothing and keeps everything;
rows with equal ids never remove from each other; texts of any length are cut into overlapping
pieces for hashing only.  Of segments that a document repeats only the first is looked up; the others lose
the same windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import flat_bytes, mix64, pieces_for, ready, staged

GRAM = 20
NEAR = 15
LONGEST = 48
PIECE = 1 << 20
BATCH_BYTES = 16 << 20
BUCKET_BYTES = 12 << 20
HOT = 8
WILD = 0x80
MANY = 0x40
TEXT, SPAN, CANDIDATE, ENTRY, ECHO = 0, 1, 2, 3, 4
U = np.uint64
FACTOR = U(0x9E3779B97F4A7C15)
M40 = U((1 << 40) - 1)
SCHEMA = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"


def _grams(x: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes of all runs of 1, 2, 4, ... bytes that ``sizes`` asks for."""
    h, s, p, out = x.astype(U) + U(1), 1, int(FACTOR), {}
    while True:
        if s in sizes:
            out[s] = h
        if s >= max(sizes) or len(h) <= s:
            return out
        h = h[:-s] * U(p) + h[s:]
        p, s = p * p & 0xFFFFFFFFFFFFFFFF, 2 * s


def window_hash(x: np.ndarray, width: int, h16: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of every ``width``-byte window (16 bytes or more)."""
    n = len(x) - width + 1
    out = np.zeros(n, U)
    for k, at in enumerate([*range(0, width - 15, 16), width - 16]):
        out += h16[at : at + n] * mix64(np.array([salt * 64 + k + 1], U))[0]
    return mix64(out)


def _least(g: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest value of each run of ``w`` and the place of its first occurrence."""
    m, at, s = g, np.arange(len(g), dtype=np.int32), 1
    while 2 * s <= w:
        left = m[:-s] <= m[s:]
        m, at, s = np.where(left, m[:-s], m[s:]), np.where(left, at[:-s], at[s:]), 2 * s
    if r := w - s:
        left = m[: len(m) - r] <= m[r:]
        m, at = np.where(left, m[: len(m) - r], m[r:]), np.where(left, at[: len(at) - r], at[r:])
    return m, at


def segments(data: np.ndarray, offsets: np.ndarray, width: int):
    """Gram, segment hash, side marks, row, start and number of windows of each segment of the rows' texts."""
    n = len(data) - width + 1
    if n <= 0:
        return [np.empty(0, k) for k in (U, U, np.uint8, np.int64, np.int64, np.uint8)]
    h = _grams(data, (4, 8, 16))
    g = mix64(h[16][: len(data) - GRAM + 1] * FACTOR + h[4][16 : 16 + len(data) - GRAM + 1])
    m, at = _least(g, width - GRAM + 1)
    whole = window_hash(data, width, h[16])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    good = np.flatnonzero(np.arange(width, width + n) <= offsets[row + 1])
    if not len(good):
        return [np.empty(0, k) for k in (U, U, np.uint8, np.int64, np.int64, np.uint8)]
    mm, rr = m[good], row[good]
    fresh = np.concatenate([[True], (mm[1:] != mm[:-1]) | (rr[1:] != rr[:-1])])
    run = np.flatnonzero(fresh)
    length = np.diff(np.append(run, len(good)))
    parts = -(-length // LONGEST)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(run, parts) + k * LONGEST
    count = np.minimum(np.repeat(length, parts) - k * LONGEST, LONGEST)
    s = good[first]
    e = s + count - 1
    seg = mix64(whole[s] * U(5) + whole[e] + count.astype(U))
    p = at[s]
    lo, hi = offsets[rr[first]], offsets[rr[first] + 1]
    near = lambda q: (mix64(h[8][np.clip(q, 0, len(h[8]) - 1)] * FACTOR + h[8][np.clip(q + NEAR - 8, 0, len(h[8]) - 1)]) % U(7)).astype(np.uint8)
    left = np.where(p - NEAR >= lo, near(p - NEAR), 7)
    right = np.where(p + GRAM + NEAR <= hi, near(p + GRAM), 7)
    marks = (left << 3 | right).astype(np.uint8) | np.where(at[e] != p, WILD, 0).astype(np.uint8)
    # least values crowd at the low end: mix again before they are dealt into buckets
    return mix64(m[s]), seg, marks, rr[first], s - lo, count.astype(np.uint8)


def _pieces(column, width: int):
    """Texts of an Arrow column in groups of bounded size, long ones in overlapping pieces: bytes, offsets, rows, places in the row."""
    data, offsets = flat_bytes(column)
    spans = []
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, max(b - width + 1, a + 1), PIECE):
            spans.append((at, min(at + PIECE + width - 1, b), r, at - a))
    k = 0
    while k < len(spans):
        j, size = k, 0
        while j < len(spans) and (j == k or size + spans[j][1] - spans[j][0] <= PIECE):
            size += spans[j][1] - spans[j][0]
            j += 1
        group = spans[k:j]
        yield np.concatenate([data[a:b] for a, b, _, _ in group]), np.concatenate([[0], np.cumsum([b - a for a, b, _, _ in group])]), np.array([x[2] for x in group]), np.array([x[3] for x in group])
        k = j


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _from_low(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view(U).ravel()


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "kind", "a", "b", "c", "d", "e"])


def document_keys(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """One number per document: its id, and 32 bits of its text's hash in case ids repeat."""
    return mix64(ids.view(U)) + tags.astype(U)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _by(bucket: np.ndarray):
    """Positions of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(bucket[part[0]]), part


def _span_rows(kind: int, key: np.ndarray, pos: np.ndarray, count: np.ndarray, buckets: int) -> list[tuple]:
    """Spans or candidates of documents (by key), dealt to the documents' buckets; touching spans of one document are joined."""
    if not len(key):
        return []
    order = np.lexsort((pos, key))
    key, pos, count = key[order], pos[order].astype(np.int64), count[order].astype(np.int64)
    if kind == SPAN:
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] > pos[:-1] + count[:-1])])
        at = np.flatnonzero(fresh)
        end = np.maximum.reduceat(pos + count, at)
        key, pos = key[at], pos[at]
        count = end - pos
    return [(b, kind, _pack(key[p]), _pack(pos[p].astype(np.uint32)), _pack(count[p].astype(np.uint32)), None, None) for b, p in _by(_bucket(mix64(key), buckets))]


def _without_echoes(e: Entries, buckets: int) -> tuple[Entries, list[tuple]]:
    """Of equal segments of one document (sorted entries) the first; the others are told, dealt by document, to do as it does."""
    if not len(e):
        return e, []
    again = np.concatenate([[False], (e.m[1:] == e.m[:-1]) & (e.seg[1:] == e.seg[:-1]) & (e.key[1:] == e.key[:-1])])
    at = np.flatnonzero(again)
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(e))))[at]
    order = np.lexsort((e.pos[at], e.pos[first], e.key[at]))
    at, first = at[order], first[order]
    rows = [
        (b, ECHO, _pack(e.key[at[p]]), _pack(np.diff(e.pos[first[p]].astype(np.int64), prepend=0)), _pack(np.diff(e.pos[at[p]].astype(np.int64), prepend=0)), _pack(e.count[at[p]]), None)
        for b, p in _by(_bucket(mix64(e.key[at]), buckets))
    ]
    return e.take(~again), rows


class Entries:
    """Sorted entries of one batch or level: gram, segment, marks, document (id and key), place, number of windows."""

    names = ("m", "seg", "marks", "doc", "key", "pos", "count")

    def __init__(self, *columns):
        for n, c in zip(self.names, columns):
            setattr(self, n, c)

    def __len__(self):
        return len(self.m)

    def take(self, at) -> Entries:
        return Entries(*(getattr(self, n)[at] for n in self.names))

    def sorted(self) -> Entries:
        return self.take(np.argsort((self.m << U(24)) | (self.seg >> U(40)), kind="stable"))

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        return Entries(*(np.concatenate([getattr(p, n) for p in parts]) for n in Entries.names))

    def later(self) -> np.ndarray:
        """Entries (sorted) whose gram and segment an entry of a smaller document has."""
        if not len(self):
            return np.empty(0, bool)
        fresh = np.concatenate([[True], (self.m[1:] != self.m[:-1]) | (self.seg[1:] != self.seg[:-1])])
        at = np.flatnonzero(fresh)
        return self.doc > np.repeat(np.minimum.reduceat(self.doc, at), np.diff(np.append(at, len(self))))

    def tell_many(self) -> None:
        """All entries (sorted) of a gram know that one of them stands for many, whichever of them stay."""
        if (self.marks & MANY).any():
            at = np.flatnonzero(np.concatenate([[True], self.m[1:] != self.m[:-1]]))
            self.marks = self.marks | np.repeat(np.bitwise_or.reduceat(self.marks & MANY, at), np.diff(np.append(at, len(self))))

    def shared(self) -> np.ndarray:
        """Entries (sorted) that may share a window with another document's entry of the same gram."""
        if not len(self):
            return np.empty(0, bool)
        at = np.flatnonzero(np.concatenate([[True], self.m[1:] != self.m[:-1]]))
        size = np.diff(np.append(at, len(self)))
        several = np.repeat((np.minimum.reduceat(self.doc, at) < np.maximum.reduceat(self.doc, at)), size)
        flags = np.repeat(np.bitwise_or.reduceat(self.marks, at), size)
        wild, many = flags & WILD > 0, flags & MANY > 0
        group = np.repeat(np.arange(len(at)), size)
        out = several & wild | many
        for shift in (3, 0):
            mark = self.marks >> shift & 7
            known = np.flatnonzero(several & ~wild & ~many & (mark < 7))
            label = group[known] * 8 + mark[known]
            order = np.argsort(label, kind="stable")
            label, places = label[order], known[order]
            if len(label):
                cut = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
                docs = self.doc[places]
                out[places] |= np.repeat(np.minimum.reduceat(docs, cut) < np.maximum.reduceat(docs, cut), np.diff(np.append(cut, len(label))))
        return out


class Family:
    """Levels of sorted entries; each new array meets all levels, and levels of like size merge."""

    def __init__(self):
        self.levels: list[Entries] = []
        self.spans: list[Entries] = []

    def add(self, new: Entries) -> None:
        self.levels.append(self._settle(new.sorted()))
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._settle(Entries.joined([a, b]).sorted()))

    def _settle(self, entries: Entries) -> Entries:
        """Merge-scan: later copies become spans and leave the index; their first stays."""
        late = entries.later()
        if late.any():
            entries.tell_many()
            self.spans.append(entries.take(late))
            entries = entries.take(~late)
        return entries

    def closed(self) -> tuple[Entries | None, list[Entries]]:
        while len(self.levels) > 1:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._settle(Entries.joined([a, b]).sorted()))
        return (self.levels[0] if self.levels else None), self.spans


def _entries(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Per batch: entries dealt by gram; spans that the batch settles itself, dealt by document."""

    def flush(parts: list[Entries]):
        e = Entries.joined(parts).sorted()
        e, rows = _without_echoes(e, buckets)
        late = e.later()
        rows += _span_rows(SPAN, e.key[late], e.pos[late], e.count[late], buckets)
        e = e.take(~late)
        # a gram with many segments here sends one or two marks; its segments are settled by their windows
        at = np.flatnonzero(np.concatenate([[True], e.m[1:] != e.m[:-1]])) if len(e) else np.empty(0, np.int64)
        hot = np.repeat(np.diff(np.append(at, len(e))) > HOT, np.diff(np.append(at, len(e))))
        if hot.any():
            rows += _span_rows(CANDIDATE, e.key[hot], e.pos[hot], e.count[hot], buckets)
            e.marks = np.where(hot, e.marks | MANY, e.marks)
            # two documents are needed to make a gram shared: the mark takes the least and the greatest
            least = np.repeat(np.minimum.reduceat(e.doc, at), np.diff(np.append(at, len(e))))
            most = np.repeat(np.maximum.reduceat(e.doc, at), np.diff(np.append(at, len(e))))
            ends = np.zeros(len(e), bool)
            for bound in (least, most):
                places = np.flatnonzero(hot & (e.doc == bound))
                _, one = np.unique(e.m[places], return_index=True)
                ends[places[one]] = True
            e = e.take(~hot | ends)
        for b, p in _by(_bucket(e.m, buckets)):
            p = p[np.lexsort((e.pos[p], e.key[p], e.doc[p]))]
            x = e.take(p)
            fresh = np.flatnonzero(np.concatenate([[True], (x.key[1:] != x.key[:-1]) | (x.doc[1:] != x.doc[:-1])]))
            tags = (x.key[fresh] - mix64(x.doc[fresh].view(U))).astype(np.uint32)
            docs_ = _pack(np.concatenate([np.diff(x.doc[fresh], prepend=0).view(np.uint32), tags, np.diff(np.append(fresh, len(x))).astype(np.uint32)]))
            gaps = np.diff(x.pos.astype(np.int64), prepend=0)
            gaps[fresh] = x.pos[fresh]
            rows.append((b, ENTRY, _low_bytes(x.m & M40, 5), _low_bytes(x.seg >> U(16), 6), x.marks.tobytes(), docs_, _pack(np.concatenate([gaps.astype("<u4").view(np.uint8), x.count]))))
        return rows

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            keys = document_keys(np.array(ids, np.int64), np.array(batch.column("tag").to_pylist(), np.int64))
            for data, offsets, rows, places in _pieces(batch.column("text"), width):
                m, seg, marks, row, pos, count = segments(data, offsets, width)
                if len(m):
                    doc = np.array([ids[r] for r in rows], np.int64)
                    parts.append(Entries(m, seg >> U(16) << U(16), marks, doc[row], keys[rows][row], (pos + places[row]).astype(np.uint32), count))
                held += len(data)
            if held >= BATCH_BYTES and parts:
                for r in flush(parts):
                    yield _batch([r])
                parts, held = [], 0
        if parts:
            for r in flush(parts):
                yield _batch([r])

    return docs.filter("doc_id is not null").select("doc_id", "tag", "text").mapInArrow(run, SCHEMA)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "a", "b", "c", "d", "e")))


def _settled(dealt: DataFrame, buckets: int) -> DataFrame:
    """Spans and candidates of every gram bucket."""

    def finish(family: Family):
        rest, spans = family.closed()
        out = []
        if spans:
            s = Entries.joined(spans)
            out += _span_rows(SPAN, s.key, s.pos, s.count, buckets)
        if rest is not None:
            c = rest.take(rest.shared())
            out += _span_rows(CANDIDATE, c.key, c.pos, c.count, buckets)
        return out

    def run(batches):
        family, current = None, None
        for bucket, kind, a, b, c, d, e in _rows(batches):
            if kind != ENTRY:
                yield _batch([(bucket, kind, a, b, c, d, e)])
                continue
            if bucket != current:
                if family is not None:
                    for r in finish(family):
                        yield _batch([r])
                family, current = Family(), bucket
            m, seg, marks = _from_low(a, 5), _from_low(b, 6) << U(16), np.frombuffer(c, np.uint8)
            raw = _unpack(d, np.uint32)
            n = len(raw) // 4
            doc, size = np.cumsum(raw[: 2 * n].view(np.int64)), raw[3 * n :].astype(np.int64)
            key = document_keys(doc, raw[2 * n : 3 * n])
            last = _unpack(e, np.uint8)
            gaps, count = last[: 4 * len(m)].view("<u4").astype(np.int64), last[4 * len(m) :]
            first = np.cumsum(size) - size
            run_ = np.cumsum(gaps)
            pos = run_ - np.repeat(run_[first] - gaps[first], size)
            family.add(Entries(m, seg, marks, np.repeat(doc, size), np.repeat(key, size), pos.astype(np.uint32), count))
        if family is not None:
            for r in finish(family):
                yield _batch([r])

    return dealt.mapInArrow(run, SCHEMA)


def _texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts in compressed blocks, dealt by document."""

    def flush(ids, tags, texts):
        key = document_keys(np.array([i or 0 for i in ids], np.int64), np.array(tags, np.int64))
        for b, p in _by(_bucket(mix64(key), buckets)):
            some = [texts[k] for k in p]
            yield _batch([(b, TEXT, _pack(np.frombuffer(b"".join(some), np.uint8)), _pack(np.array([len(t) for t in some], np.int64)), _pack(key[p]), _pack(np.array([ids[k] or 0 for k in p], np.int64)), np.array([ids[k] is None for k in p]).tobytes())])

    def run(batches):
        ids, tags, texts, held = [], [], [], 0
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            tags += batch.column("tag").to_pylist()
            for t in batch.column("text"):
                texts.append(t.as_py().encode())
                held += len(texts[-1])
            if held >= BATCH_BYTES:
                yield from flush(ids, tags, texts)
                ids, tags, texts, held = [], [], [], 0
        if ids:
            yield from flush(ids, tags, texts)

    return docs.select("doc_id", "tag", "text").mapInArrow(run, SCHEMA)


def _echoed(key: np.ndarray, pos: np.ndarray, count: np.ndarray, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans, and for each echo those parts of them that lie in the first of its segments, at the echo's place.

    Spans are runs of window starts, sorted by document and start; they come back so sorted.
    """
    added = []
    for a, b, c, d, _ in rows:
        own, first, at, n = _unpack(a, U), np.cumsum(_unpack(b, np.int64)), np.cumsum(_unpack(c, np.int64)), _unpack(d, np.uint8).astype(np.int64)
        lo, hi = np.searchsorted(key, own), np.searchsorted(key, own, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            s = np.maximum(pos[lo[k] : hi[k]], first[k])
            e = np.minimum(pos[lo[k] : hi[k]] + count[lo[k] : hi[k]], first[k] + n[k])
            hit = e > s
            if hit.any():
                added.append((np.repeat(own[k], hit.sum()), s[hit] + at[k] - first[k], (e - s)[hit]))
    if not added:
        return key, pos, count
    key, pos, count = (np.concatenate([x, *more]) for x, more in zip((key, pos, count), zip(*added)))
    order = np.lexsort((pos, key))
    return key[order], pos[order], count[order]


def _found_spans(kind_rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, starts and counts of span rows, sorted by key and start."""
    if not kind_rows:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    key = np.concatenate([_unpack(r[0], U) for r in kind_rows])
    pos, count = (np.concatenate([_unpack(r[k], np.uint32) for r in kind_rows]).astype(np.int64) for k in (1, 2))
    order = np.lexsort((pos, key))
    return key[order], pos[order], count[order]


def _per_bucket(batches):
    """For each bucket its rows by kind."""
    current, held = None, {}
    for bucket, kind, *rest in _rows(batches):
        if bucket != current:
            if held:
                yield held
            current, held = bucket, {}
        held.setdefault(kind, []).append(tuple(rest))
    if held:
        yield held


def _windows(dealt: DataFrame, width: int, buckets: int) -> DataFrame:
    """Windows of candidate segments, dealt by their hash; within a task the first document of each is enough."""

    def run(batches):
        for rows in _per_bucket(batches):
            texts = rows.get(TEXT, [])
            key, pos, count = _found_spans(rows.get(CANDIDATE, []))
            h1s, h2s, docs, keys, starts = [], [], [], [], []
            for a, b, c, d, e in texts if len(key) else ():
                data, sizes, own, ids = _unpack(a, np.uint8), _unpack(b, np.int64), _unpack(c, U), _unpack(d, np.int64)
                begins = np.cumsum(sizes) - sizes
                lo, hi = np.searchsorted(key, own), np.searchsorted(key, own, "right")
                pieces, size = [], 0
                for k in np.flatnonzero((hi > lo) & ~np.frombuffer(e, bool)).tolist():
                    for j in range(lo[k], hi[k]):
                        pieces.append((k, int(pos[j]), int(count[j])))
                for group in range(0, len(pieces), 8192):
                    some = pieces[group : group + 8192]
                    x = np.concatenate([data[begins[k] + p : begins[k] + p + n + width - 1] for k, p, n in some])
                    n = np.array([p[2] for p in some])
                    h16 = _grams(x, (16,))[16]
                    first = np.cumsum(n + width - 1) - (n + width - 1)
                    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    h1s.append(window_hash(x, width, h16)[at])
                    h2s.append((window_hash(x, width, h16, 1)[at] >> U(32)).astype(np.uint32))
                    k = np.array([p[0] for p in some])
                    docs.append(np.repeat(ids[k], n))
                    keys.append(np.repeat(own[k], n))
                    starts.append(np.repeat(np.array([p[1] for p in some]), n) + at - np.repeat(first, n))
            if not h1s:
                continue
            h1, h2, doc, own, start = (np.concatenate(x) for x in (h1s, h2s, docs, keys, starts))
            late, order = _later_windows(h1, h2, doc)
            for r in _span_rows(SPAN, own[order][late], start[order][late], np.ones(late.sum(), np.int64), buckets):
                yield _batch([r])
            order = order[~late]
            for w, p in _by(_bucket(h1[order], buckets)):
                p = order[p]
                p = p[np.lexsort((start[p], own[p]))]
                yield _batch([(w, ENTRY, h1[p].tobytes(), h2[p].tobytes(), _pack(doc[p]), _pack(own[p]), _pack(np.diff(start[p], prepend=0).astype(np.int32)))])

    return dealt.mapInArrow(run, SCHEMA)


def _later_windows(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In hash order: which windows a smaller document has too."""
    order = np.lexsort((h2, h1))
    a, b, d = h1[order], h2[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return d > np.repeat(np.minimum.reduceat(d, at), np.diff(np.append(at, len(d)))), order


def _window_spans(dealt: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        current, held = None, []

        def finish():
            h1, h2, doc, key, start = (np.concatenate(x) for x in zip(*held))
            late, order = _later_windows(h1, h2, doc)
            return _span_rows(SPAN, key[order][late], start[order][late], np.ones(late.sum(), np.int64), buckets)

        for bucket, kind, a, b, c, d, e in _rows(batches):
            if kind != ENTRY:
                yield _batch([(bucket, kind, a, b, c, d, e)])
                continue
            if bucket != current and held:
                for r in finish():
                    yield _batch([r])
                held = []
            current = bucket
            held.append((np.frombuffer(a, U), np.frombuffer(b, np.uint32), _unpack(c, np.int64), _unpack(d, U), np.cumsum(_unpack(e, np.int32).astype(np.int64))))
        if held:
            for r in finish():
                yield _batch([r])

    return dealt.mapInArrow(run, SCHEMA)


def _removed(dealt: DataFrame, width: int) -> DataFrame:
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int64(), span, pa.binary()])], names=["doc_id", "n_bytes", "spans", "kept"])

        for found in _per_bucket(batches):
            key, pos, count = _echoed(*_found_spans(found.get(SPAN, [])), found.get(ECHO, []))
            for a, b, c, d, e in found.get(TEXT, []):
                data, sizes, own, ids, no_id = _unpack(a, np.uint8), _unpack(b, np.int64), _unpack(c, U), _unpack(d, np.int64), np.frombuffer(e, bool)
                begins = np.cumsum(sizes) - sizes
                lo, hi = np.searchsorted(key, own), np.searchsorted(key, own, "right")
                out, held = [], 0
                for k in range(len(sizes)):
                    text = data[begins[k] : begins[k] + sizes[k]]
                    merged = []
                    for s, n in zip(pos[lo[k] : hi[k]].tolist(), count[lo[k] : hi[k]].tolist()):
                        if merged and s <= merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], s + n + width - 1)
                        else:
                            merged.append({"start": s, "end": s + n + width - 1})
                    if merged:
                        keep = np.ones(len(text), bool)
                        for x in merged:
                            keep[x["start"] : x["end"]] = False
                        text = text[keep]
                    out.append((None if no_id[k] else int(ids[k]), int(sizes[k]), merged, text.tobytes()))
                    held += len(text)
                    if held > (4 << 20):
                        yield rows(out)
                        out, held = [], 0
                if out:
                    yield rows(out)

    return dealt.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed runs ``[start, end)`` in UTF-8 bytes, and the bytes that stay."""
    spark = ready(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), (F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))).alias("tag"))
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = pieces_for(spark, total, BUCKET_BYTES)
    entries = _entries(held, width, buckets)
    settled = staged(_settled(_dealt(entries, buckets), buckets), "settled")
    candidates = settled.filter(F.col("kind") == CANDIDATE)
    windows = _windows(_dealt(_texts(held, buckets).unionByName(candidates), buckets), width, buckets)
    more = staged(_window_spans(_dealt(windows, buckets), buckets), "window-spans")
    spans = settled.filter(F.col("kind").isin(SPAN, ECHO)).unionByName(more)
    return _removed(_dealt(_texts(held, buckets).unionByName(spans), buckets), width)
