"""Language identification by interpolated Kneser-Ney models of characters, one per language.

Characters fold to 64 symbols (space, a-z, other letters), so a model of order four has at most
64^4 keys however large the corpus.  Four-gram counts cover every training text and are added up
by Spark; continuation counts and discounts follow from them.  Four-grams lie in one sorted key
array with a column per language, lower orders in dense tables.  A text goes to the language with
the lowest cross-entropy per symbol.

A text is rejected if it is null or has no letter, or if its best cross-entropy lies beyond what
texts of that language and length show (calibrated on all labelled rows, added up per language; a
language with fewer than ``FEW`` of them takes the limit of all languages together).

Defined results: a null or letterless text is ``und`` with score 0; ties go to the first language by
name; rows without a language are not learned from; without any labelled row everything is
``und``; repeated rows count as often as they stand; very long texts are scored in pieces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ready, with_row

ORDER = 4
PIECE = 1 << 20
FLUSH = 1 << 21
LIMIT = 512 << 20
UNKNOWN = "und"
TEXTS = -1
LEAST_SPREAD = 0.04
FEW = 16
TEMPERS = [2.0**-k for k in range(12)]
_tables: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """Symbol of each code point: 0 for anything but letters, 1-26 for a-z, 27-63 for other letters."""
    if not _tables:
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[i] = low - 96 if 97 <= low <= 122 else 27 + low % 37
        _tables.append(table)
    return _tables[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Four-gram codes of all texts in a row, and where each text's codes start; runs of other characters are one space."""
    table = symbols()
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = table[np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    keep = raw > 0
    keep[1:] |= raw[:-1] > 0
    keep[ends - 1] = True  # one space at least ends each text
    at = np.cumsum(keep)
    starts = np.where(starts > 0, at[starts - 1], 0)
    s = raw[keep].astype(np.uint32)
    code = s.copy()
    for k in range(1, ORDER):
        back = np.zeros_like(s)
        back[k:] = s[:-k]
        for j in range(k):
            inside = starts + j
            back[inside[inside < len(back)]] = 0
        code |= back << np.uint32(6 * k)
    return code, starts


def _split(texts) -> tuple[list[str], list[int]]:
    """Texts in pieces of bounded length, and the row of each piece."""
    pieces, rows = [], []
    for k, t in enumerate(texts):
        for a in range(0, len(t), PIECE) if t else ():
            pieces.append(t[a : a + PIECE])
            rows.append(k)
    return pieces, rows


@dataclass
class Model:
    """Log-probabilities in bits: sorted four-gram keys with a column per language, dense lower orders and backoffs."""

    langs: list[str]
    keys: np.ndarray
    high: np.ndarray  # keys x languages, NaN where a language has not seen the key
    low: np.ndarray  # 64^3 x languages
    back: np.ndarray  # 64^3 x languages
    temper: float = 1.0
    limits: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def bits(self, code: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        out = self.high[place]
        missing = np.isnan(out) | (self.keys[place] != code)[:, None]
        rows = np.flatnonzero(missing.any(axis=1))
        if len(rows):
            c = code[rows]
            lower = self.back[c >> np.uint32(6)] + self.low[c & np.uint32((1 << 18) - 1)]
            out[rows] = np.where(missing[rows], lower, out[rows])
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log2-probabilities per text and language, and the number of symbols scored."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        pieces, rows = _split(texts)
        a = 0
        while a < len(pieces):
            b, size = a, 0
            while b < len(pieces) and (b == a or size + len(pieces[b]) <= PIECE):
                size += len(pieces[b])
                b += 1
            code, starts = grams(pieces[a:b])
            np.add.at(sums, rows[a:b], np.add.reduceat(self.bits(code), starts, axis=0, dtype=np.float64))
            np.add.at(counts, rows[a:b], np.diff(np.append(starts, len(code))))
            a = b
        return sums, counts

    def decide(self, texts: list[str | None]):
        """Language, score, cross-entropy and rejection of each text."""
        if not self.langs:
            return [(UNKNOWN, 0.0, None, True)] * len(texts)
        plain, out = [t or "" for t in texts], []
        sums, counts = self.score(plain)
        for t, s, n in zip(plain, sums, counts.tolist()):
            if not n or not any(c.isalpha() for c in t):
                out.append((UNKNOWN, 0.0, None, True))
                continue
            best = int(np.argmax(s))
            weights = np.exp2(np.maximum(self.temper * (s - s[best]), -1000))
            h = -s[best] / n
            mean, spread, per_symbol = self.limits.get(self.langs[best], (np.inf, 0.0, 0.0))
            out.append((self.langs[best], float(1 / weights.sum()), float(h), bool(h > mean + 8 * np.sqrt(spread + per_symbol / n))))
        return out


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


def kneser_ney(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one language: probability of each key, of all trigrams by continuation, and backoff weights of contexts."""
    one_if = lambda total, x: np.where(total > 0, x, 1.0)  # noqa: E731  an unseen context backs off whole
    cont3 = np.bincount(keys & ((1 << 18) - 1), minlength=1 << 18)
    cont2 = (cont3.reshape(64, 4096) > 0).sum(axis=0)
    cont1 = (cont2.reshape(64, 64) > 0).sum(axis=0)
    d1 = _discount(cont1)
    p = np.maximum(cont1 - d1, 0) / max(cont1.sum(), 1) + one_if(cont1.sum(), d1 * (cont1 > 0).sum() / max(cont1.sum(), 1)) / 64
    for cont in (cont2, cont3):
        by = cont.reshape(-1, 64)
        total, d = by.sum(axis=1), _discount(cont)
        safe = np.maximum(total, 1)
        backoff = one_if(total, d * (by > 0).sum(axis=1) / safe)
        lower = np.tile(p, len(cont) // len(p))
        p = np.maximum(cont - d, 0) / np.repeat(safe, 64) + np.repeat(backoff, 64) * lower
    context = keys >> 6
    total, kinds, d = np.bincount(context, counts, 1 << 18), np.bincount(context, minlength=1 << 18), _discount(counts)
    safe = np.maximum(total, 1)
    backoff = one_if(total, d * kinds / safe)
    high = np.maximum(counts - d, 0) / safe[context] + backoff[context] * p[keys & ((1 << 18) - 1)]
    return high, p, backoff


def gram_counts(train: DataFrame) -> DataFrame:
    """``(lang, key, n)`` over all texts of ``train(lang, text)``, and their number at key ``TEXTS``; tasks add up before the shuffle."""

    def run(batches):
        import pyarrow as pa

        held: dict[str, list] = {}
        seen: dict[str, int] = {}

        def merged(parts):
            keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            return keys[first], np.add.reduceat(counts, first) if len(first) else counts

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
                seen[lang] = seen.get(lang, 0) + 1
            for lang, texts in by_lang.items():
                pieces, _ = _split(texts)
                if not pieces:
                    continue
                parts = held.setdefault(lang, [])
                a = 0
                while a < len(pieces):
                    b, size = a, 0
                    while b < len(pieces) and (b == a or size + len(pieces[b]) <= PIECE):
                        size += len(pieces[b])
                        b += 1
                    parts.append(np.unique(grams(pieces[a:b])[0], return_counts=True))
                    a = b
                if sum(len(p[0]) for p in parts) > FLUSH:
                    held[lang] = [merged(parts)]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([TEXTS] * len(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["lang", "key", "n"])
        for lang, parts in held.items():
            keys, counts = merged(parts)
            for a in range(0, len(keys), 100_000):
                k, c = keys[a : a + 100_000], counts[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(c.astype(np.int64))], names=["lang", "key", "n"])

    return train.mapInArrow(run, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 4096, limit_bytes: int = LIMIT) -> Model:
    """Learn from every row with a text and a language, and calibrate on every one; ``sample`` is accepted and limits nothing."""
    ready(labelled.sparkSession)
    train = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = gram_counts(train).toPandas()
    counts = counts[counts["key"] != TEXTS]
    langs = sorted(counts["lang"].unique())
    all_keys = np.unique(counts["key"].to_numpy()).astype(np.uint32)
    if (size := len(all_keys) * (4 + 4 * len(langs)) + (8 * len(langs) << 18)) > limit_bytes:
        raise ValueError(f"the model has {size} bytes, more than limit_bytes={limit_bytes}")
    high = np.full((len(all_keys), len(langs)), np.nan, np.float32)
    low, back = (np.empty((1 << 18, len(langs)), np.float32) for _ in range(2))
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        keys = own["key"].to_numpy().astype(np.int64)
        p4, p3, weight = kneser_ney(keys, own["n"].to_numpy())
        high[np.searchsorted(all_keys, keys.astype(np.uint32)), k] = np.log2(p4)
        low[:, k], back[:, k] = np.log2(p3), np.log2(weight)
    model = Model(langs, all_keys, high, low, back)
    if langs:
        calibrate(model, train)
    return model


def _limit(total: np.ndarray) -> tuple[float, float, float]:
    """Mean cross-entropy, its spread, and what a short text adds to it, from sums over rows (see ``calibrate``)."""
    rows, symbols, bits, h, hh, i, ii, ih, ihh = total
    mean = bits / symbols
    squares = max(hh / rows - 2 * mean * h / rows + mean * mean, 0.0)
    together = (ihh - 2 * mean * ih + mean * mean * i) / rows
    inverse, varies = i / rows, ii / rows - (i / rows) ** 2
    slope = max(0.0, (together - inverse * squares) / varies) if varies > 1e-9 * ii / rows else 0.0
    # mixed but sound texts differ by some tenths of a bit: never expect less spread than that
    return float(mean), float(max(squares - slope * inverse, LEAST_SPREAD)), float(slope)


def calibrate(model: Model, train: DataFrame) -> None:
    """Temper of the score, and per language the mean cross-entropy and its spread by length.

    Every row is scored where it is; tasks add up powers of its cross-entropy and of its inverse length
    and its loss at each temper, so one row per task and language moves.
    """
    shared = train.sparkSession.sparkContext.broadcast(model)
    width = 9 + len(TEMPERS)

    def run(batches):
        import pyarrow as pa

        known = shared.value
        place = {lang: k for k, lang in enumerate(known.langs)}
        totals = np.zeros((len(known.langs), width))
        for batch in batches:
            sums, n = known.score([t.as_py() for t in batch.column("text")])
            truth = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            good = (n > 0) & (truth >= 0)
            sums, n, truth = sums[good], n[good].astype(np.float64), truth[good]
            top, own = sums.max(axis=1, initial=-np.inf), sums[np.arange(len(n)), truth]
            h, i = -own / n, 1 / n
            columns = [np.ones(len(n)), n, -own, h, h * h, i, i * i, i * h, i * h * h]
            for t in TEMPERS:
                z = t * (sums - top[:, None])
                columns.append(np.log2(np.exp2(np.maximum(z, -1000)).sum(axis=1)) - t * (own - top))
            np.add.at(totals, truth, np.stack(columns, axis=1))
        seen = np.flatnonzero(totals[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array([known.langs[k] for k in seen], pa.string()), *(pa.array(totals[seen, c]) for c in range(width))],
            names=["lang", *(f"c{c}" for c in range(width))],
        )

    names = [f"c{c}" for c in range(width)]
    scored = train.mapInArrow(run, "lang string, " + ", ".join(f"{c} double" for c in names))
    found = {r["lang"]: np.array([r[c] for c in names]) for r in scored.groupBy("lang").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    shared.destroy()
    if not found:
        return
    pooled = np.sum([found[lang] for lang in sorted(found)], axis=0)
    model.temper = TEMPERS[int(np.argmin(pooled[9:]))]
    mean, spread, slope = _limit(pooled[:9])
    for lang in model.langs:
        own = found.get(lang)
        if own is not None and own[0] >= FEW:
            model.limits[lang] = _limit(own[:9])
        else:
            model.limits[lang] = (mean if own is None else max(mean, float(own[2] / own[1])), spread, slope)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in ``row``, with ``lang_pred, score, cross_entropy, rejected``; nothing is shuffled."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    held = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = shared.value.decide(batch.column("text").to_pylist())
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            columns = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["row", "lang_pred", "score", "cross_entropy", "rejected"])

    return held.mapInArrow(run, with_row(held, "lang_pred string, score double, cross_entropy double, rejected boolean"))


def fold(id_col: str = "doc_id") -> Column:
    """The fold of a document, 0 to 4; fold 0 is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5
