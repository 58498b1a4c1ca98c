"""Personal data by weak supervision; DataFrame functions only.

Patterns, gazetteers and context labelers vote on every candidate span.  Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is and how likely a span with
such votes is personal data; a naive Bayes span classifier is trained on those likelihoods and
decides.  Base spans (valid e-mail, IP, card and phone matches) stay whatever it says; accepted
candidates that touch no base span are added.

The driver sees vote patterns and feature weights: at most 3^5 patterns for each of eight kinds, and
a few hundred features, however many documents there are.

Defined results: a null or empty text has no spans; offsets count code points, ends exclusive;
repeated rows are treated alike; without candidates nothing is added; very long texts are searched
whole.  The patterns run in linear time; the handling of what they find grows with the square of the number of
spans in one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ready, staged

# fixed values: kinds in the order that decides ties, the base ones first
BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "secret", "tel", "name")
KINDS = BASE + ADDED
# fixed values: cues, endings, prefixes and given names that the gazetteers know
ENDINGS = "com org net edu gov int info biz io co de fr es it uk us eu ch at nl be".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
CUES = "tel phone call mobile fax email mail contact card visa mastercard account iban ip host server login user password passwd secret token key auth name".split()
SECRET_CUES = "token secret password passwd key auth bearer credential".split()
GIVEN = "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Maria Peter Paul Hans Klaus Pierre Marie Jean Juan José Carlos Carmen Laura".split()
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# The base patterns, written so that no text makes them retry a run of characters from each of its places:
# a match may start at a run's first character or where the match before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # only runs of 14 to 19 digits can be valid, and such a run is always one whole match
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Za-z]{20,128}+(?![0-9A-Za-z])",
    "tel": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "name": r"\b(?:" + "|".join(GIVEN) + r")\x20\p{Lu}\p{Ll}{2,20}\b",
}
CONTEXT = 40
BLOCK = 128
SHAPES = 64
ROUNDS = 50


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    d = F.reverse(_digits(s))

    def add(acc, i):
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """The base rule of a kind beyond its pattern."""
    if kind == "ip":
        return F.rlike(s, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if kind == "card":
        return F.length(_digits(s)).between(14, 19) & _luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _worth(kind: str, text: Column) -> Column:
    """A cheap sign that a text can have such a match at all."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return F.lit(True) if kind == "name" else F.col("_digit")


def locate(df: DataFrame, text: str) -> DataFrame:
    """Adds a column ``_<kind>`` per pattern: ``array<struct<start,end,s>>`` of its matches, left to right.

    A match's place is the length of what lies before it: the texts between matches and the matches,
    added up in blocks, so that a text with very many matches stays linear.
    """
    t = F.col(text)
    df = df.withColumn("_digit", F.rlike(t, F.lit("[0-9]")))
    df = df.select("*", *[F.when(_worth(k, t), F.regexp_extract_all(t, F.lit(p), F.lit(0))).alias(f"m_{k}") for k, p in PATTERNS.items()])
    gaps = [F.when(F.size(f"m_{k}") > 0, F.split(t, p, -1)).alias(f"g_{k}") for k, p in PATTERNS.items()]
    df = df.select("*", *gaps)
    blocks = []
    for k in PATTERNS:
        z = F.zip_with(f"m_{k}", F.slice(F.col(f"g_{k}"), F.lit(1), F.size(f"m_{k}")), lambda a, b: F.struct(a.alias("s"), F.length(b).alias("gap"), F.length(a).alias("n")))
        blocks.append(z.alias(f"z_{k}"))
    df = df.select(*[c for c in df.columns if c[:2] not in ("m_", "g_")], *blocks)

    def in_blocks(z: str) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int"))
        return F.when(F.size(z) > 0, F.transform(numbers, lambda b: F.slice(F.col(z), b * BLOCK + 1, F.lit(BLOCK))))

    df = df.select(*[c for c in df.columns if c[:2] != "z_"], *[in_blocks(f"z_{k}").alias(f"b_{k}") for k in PATTERNS])
    ends = [
        F.aggregate(
            F.transform(f"b_{k}", lambda blk: F.aggregate(blk, F.lit(0), lambda a, x: a + x["gap"] + x["n"])),
            F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
        ).alias(f"e_{k}")
        for k in PATTERNS
    ]
    df = df.select("*", *ends)
    none = F.expr("cast(array() as array<struct<start:int,end:int,s:string>>)")

    def fold(blk, start):
        def step(acc, x):
            a = acc["at"] + x["gap"]
            return F.struct((a + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), (a + x["n"]).alias("end"), x["s"].alias("s")))).alias("out"))

        return F.aggregate(blk, F.struct(start.alias("at"), none.alias("out")), step)["out"]

    found = [
        F.coalesce(F.flatten(F.zip_with(f"b_{k}", F.slice(F.col(f"e_{k}"), F.lit(1), F.size(f"b_{k}")), fold)), none).alias(f"_{k}") for k in PATTERNS
    ]
    return df.select(*[c for c in df.columns if c[:2] not in ("b_", "e_") and c != "_digit"], *found)


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (the columns of ``keep``) and ``found``: ``array<struct<start,kind,end,s,left,right,ok>>``.

    ``kind`` is the number of the kind; ``ok`` tells whether the base rule holds.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = locate(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), t.alias("body")), "body")

    def of(kind: str, column: str):
        return F.transform(
            column,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), m["s"].alias("s"),
                F.substring(F.col("body"), F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT))).alias("left"),
                F.substring(F.col("body"), m["end"] + 1, F.lit(1)).alias("right"),
                (valid(kind, m["s"]) if kind in BASE else F.lit(False)).alias("ok"),
            ),
        )

    parts = [of(k, f"_{k}") for k in PATTERNS]
    # digits that fail the checksum are an account number or nothing
    out = F.transform(
        F.concat(*parts),
        lambda c: F.struct(c["start"].alias("start"), F.when((c["kind"] == 2) & ~c["ok"], KINDS.index("account")).otherwise(c["kind"]).alias("kind"), c["end"].alias("end"), c["s"].alias("s"), c["left"].alias("left"), c["right"].alias("right"), c["ok"].alias("ok")),
    )
    # e-mail, IP and phone matches that fail their rule are dropped
    return df.select("row", F.array_sort(F.filter(out, lambda c: c["ok"] | (c["kind"] >= len(BASE)))).alias("found"))


LABELERS = ("strict", "gazetteer", "cue", "edge", "against")


def votes(c: Column) -> Column:
    """The labelers' votes on a candidate, as text: ``+`` for personal data, ``-`` against, ``0`` for none."""
    s, kind, left = c["s"], c["kind"], c["left"]
    digits = F.length(_digits(s))
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    vote = lambda yes, no=None: F.when(yes, "+").when(no if no is not None else F.lit(False), "-").otherwise("0")
    strict = (
        F.when(kind == 0, vote(F.rlike(s, F.lit(r"^[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,24}$")), F.lit(True)))
        .when(kind.isin(1, 2, 3), "+")
        .when(kind == 4, vote(digits.isin(15, 16), digits.isin(14, 17, 18, 19)))
        .when(kind == 5, vote((digits >= 4) & (letters >= 4) & (F.length(s) >= 32), (digits < 2) | (letters < 2)))
        .otherwise("0")
    )
    gazetteer = (
        F.when(kind == 0, vote(F.regexp_extract(F.lower(s), r"\.([a-z]+)$", 1).isin(ENDINGS)))
        .when(kind == 3, vote(F.rlike(s, F.lit(r"^\+(?:" + "|".join(COUNTRY_CODES) + r")(?![0-9])"))))
        .when(kind.isin(2, 4), vote(F.rlike(s, F.lit("^(?:3[47]|4|5[1-5]|2[2-7]|6)"))))
        .when(kind == 5, vote(F.rlike(left, F.lit(r"(?i)(?:" + "|".join(SECRET_CUES) + r")[\"' ]{0,3}[:=][\"' ]{0,3}$"))))
        .when(kind == 7, "+")
        .otherwise("0")
    )
    cue = vote(F.rlike(left, F.lit(r"(?i)\b(?:" + "|".join(CUES) + r")\b[^\n]{0,16}$")))
    free = ~F.rlike(left, F.lit(r"[\p{L}\p{N}_]$")) & ~F.rlike(c["right"], F.lit(r"^[\p{L}\p{N}_]"))
    edge = vote(free, F.lit(True))
    against = F.when(F.rlike(left, F.lit(r"(?i)(?:[#$]|\bv(?:er(?:sion)?)?\.?|\bisbn|\bdoi|\bno\.?)[ :]{0,2}$")) | F.rlike(s, F.lit(r"^(.)\1*$")), "-").otherwise("0")
    return F.concat(strict, gazetteer, cue, edge, against)


def features(c: Column) -> Column:
    """What the span classifier sees: kind, each vote, size, and the shape of the text."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(c["s"], 1, 64), r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]+", "9")
    kind = c["kind"].cast("string")
    return F.array(
        F.concat(F.lit("kind "), kind),
        *[F.concat(F.lit(f"{name} "), F.substring(c["votes"], k + 1, 1), kind) for k, name in enumerate(LABELERS)],
        F.concat(F.lit("size "), F.least(F.floor(F.log2(F.length(c["s"]) + 1.0)), F.lit(8)).cast("string")),
        F.concat(F.lit("shape "), (F.crc32(F.encode(shape, "UTF-8")) % SHAPES).cast("string")),
    )


def reliabilities(counts: dict[tuple[int, str], int]) -> dict[tuple[int, str], float]:
    """Expectation-maximisation over vote patterns: how likely spans of a kind with these votes are personal data."""
    marks = "+-0"
    likely = {p: (1 + v.count("+")) / (2 + v.count("+") + v.count("-")) for p in counts for v in [p[1]]}
    for _ in range(ROUNDS):
        prior, right, wrong = {}, [dict.fromkeys(marks, 1.0) for _ in LABELERS], [dict.fromkeys(marks, 1.0) for _ in LABELERS]
        for (kind, v), n in counts.items():
            p = likely[kind, v]
            yes, all_ = prior.get(kind, (1.0, 2.0))
            prior[kind] = (yes + n * p, all_ + n)
            for k, mark in enumerate(v):
                right[k][mark] += n * p
                wrong[k][mark] += n * (1 - p)
        for kind, v in counts:
            odds = math.log(prior[kind][0] / (prior[kind][1] - prior[kind][0]))
            for k, mark in enumerate(v):
                odds += math.log(right[k][mark] / sum(right[k].values())) - math.log(wrong[k][mark] / sum(wrong[k].values()))
            likely[kind, v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return likely


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    known = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    return F.coalesce(F.element_at(known, key), F.lit(default))


def detect(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (the columns of ``keep``), ``base`` and ``added``: arrays of ``struct<start,kind,end>`` in order."""
    ready(docs.sparkSession)
    found = candidates(docs, keep, text_col)
    voted = F.transform(
        "found", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["s"].alias("s"), c["ok"].alias("ok"), votes(c).alias("votes"))
    )
    base = staged(found.select("row", voted.alias("found")), "candidates")
    each = base.select(F.explode("found").alias("c"))
    counts = {(r["kind"], r["votes"]): r["count"] for r in each.groupBy("c.kind", "c.votes").count().collect()}
    likely = {f"{kind}{v}": p for (kind, v), p in reliabilities(counts).items()}
    soft = each.select(F.explode(features(F.col("c"))).alias("feature"), _lookup(likely, F.concat(F.col("c.kind").cast("string"), F.col("c.votes")), 0.5).alias("p"))
    sums = soft.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    yes = sum(n * likely[f"{k}{v}"] for (k, v), n in counts.items())
    no = sum(counts.values()) - yes
    weights = {r["feature"]: math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2)) for r in sums}
    start = math.log((yes + 1) / (no + 1))
    odds = lambda c: F.aggregate(features(c), F.lit(start), lambda a, f: a + _lookup(weights, f, 0.0))
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    sure = F.transform(F.filter("found", lambda c: c["ok"]), span)
    maybe = F.filter("found", lambda c: (c["kind"] >= len(BASE)) & (odds(c) > 0))
    apart = base.select("row", sure.alias("base"), F.transform(maybe, span).alias("more"))
    clear = F.filter("more", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    single = F.aggregate(clear, none, lambda acc, a: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > a["start"]), acc).otherwise(F.concat(acc, F.array(a))))
    return apart.select("row", "base", single.alias("added"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``; each span of the text is replaced by its kind in brackets."""
    found = detect(docs, docs.columns, text_col)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col(f"row.{text_col}")
    ordered = F.array_sort(F.concat("base", "added"))

    def step(acc, s):
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        later = F.struct(s["end"].alias("at"), cut.alias("out"))
        return F.when(s["start"] >= acc["at"], later).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    row = F.col("row").withField(text_col, F.when(F.size("base") + F.size("added") == 0, text).otherwise(done))
    out = found.select(row.alias("row"))
    if length_col in docs.columns:
        new = F.length(f"row.{text_col}").cast(docs.schema[length_col].dataType)
        out = out.select(F.col("row").withField(length_col, F.coalesce(new, F.col(f"row.{length_col}"))).alias("row"))
    return out.select("row.*")
