"""Quotation linking: quoted passages find the message they come from; conversations lose their quotes.

Leading ``>`` signs give a line its level.  A passage is a run of lines of one level of one
or more.  Passages and what messages wrote themselves, whole, by line and by sentence, are normalised
(case, white space, outer punctuation), hashed and joined within the conversation.  The message that
wrote the passage's text first is its origin; for a passage that no message wrote as a whole message,
line or sentence, it is the first writer of its longest known line or sentence.  A message answers the origin of its first passage at the lowest
level; ``order_key`` puts it right after the thread it answers, other messages keep their turn.

Defined results: a null or empty text has no lines; a null conversation or turn never links; a
quote of something nobody wrote stays unlinked but is still cut out; of repeated rows each is kept;
ties between equal passages go to the earliest turn; columns besides the four named are kept in
``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ready, staged

MARKS = r"^\s*(>\s?)+"
SENTENCE_END = "(?<=[.!?\u2026][\"'\u201d\u2019)\\]]{0,1})\\s+|(?<=[\u3002\uff01\uff1f])"
LEAD_IN = r"(?i)^\s*(on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,80}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)\s*:\s*$"


def _normal(c: Column) -> Column:
    """Lower case, single spaces, no punctuation at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), r"^[\s\p{P}]+|[\s\p{P}]+$", "")


def _units(text: Column) -> Column:
    """The whole text, its lines, and its sentences (within lines, and across line breaks), normalised, none empty."""
    lines = F.split(text, "\n")
    sentences = F.concat(F.flatten(F.transform(lines, lambda l: F.split(l, SENTENCE_END))), F.split(text, SENTENCE_END))
    return F.filter(F.array_distinct(F.transform(F.concat(F.array(text), lines, sentences), _normal)), lambda u: u != "")


def _lines(text: Column) -> Column:
    """Lines with their quote level and bare text."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"),
        lambda l: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(l, MARKS, 0), r"[^>]", "")).alias("level"),
            F.regexp_replace(l, MARKS, "").alias("bare"),
            l.alias("raw"),
        ),
    )


def parse(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``lines`` (level, bare), ``own`` (the text without quotes and their lead-in lines) and ``passages`` (level, text)."""
    found = messages.withColumn("lines", _lines(F.col(text_col)))
    follows = F.transform(
        "lines", lambda l, i: F.struct(l["level"].alias("level"), l["bare"].alias("bare"), l["raw"].alias("raw"), F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0)).alias("next"), F.when(i > 0, F.get(F.col("lines"), i - 1)["level"]).alias("last"))
    )
    found = found.withColumn("lines", follows)
    own = F.filter("lines", lambda l: (l["level"] == 0) & ~((l["next"] > 0) & F.rlike(l["bare"], F.lit(LEAD_IN))))
    own_text = F.array_join(F.transform(own, lambda l: l["raw"]), "\n")
    quoted = F.filter("lines", lambda l: l["level"] > 0)
    # a run of one level: start a passage whenever the level differs from the line before
    empty = F.expr("cast(array() as array<struct<level:int,text:string>>)")

    def step(acc, l):
        joined = F.slice(acc, F.lit(1), F.size(acc) - 1)
        head = F.element_at(acc, -1)
        grown = F.concat(joined, F.array(F.struct(head["level"].alias("level"), F.concat_ws("\n", head["text"], l["bare"]).alias("text"))))
        fresh = F.concat(acc, F.array(F.struct(l["level"].alias("level"), l["bare"].alias("text"))))
        return F.when((F.size(acc) == 0) | ~F.equal_null(l["last"], l["level"]), fresh).otherwise(grown)

    passages = F.when(F.size(quoted) == 0, empty).otherwise(F.aggregate(quoted, empty, step))
    return found.withColumn("own", own_text).withColumn("passages", passages)


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``row, own, n_passages, n_linked, parent_turn, order_key``: one row per message.

    Sort by conversation and ``order_key`` to read a conversation; ``own`` is the text to show.
    """
    ready(messages.sparkSession)
    held = messages.select(
        F.struct("*").alias("row"), F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(text).alias("body"),
    )
    parsed = staged(parse(held, "body").withColumn("mid", F.xxhash64("conv", "turn", "body")).select("row", "conv", "turn", "mid", "own", "passages"), "quotes")
    passages = parsed.select("conv", "turn", "mid", F.posexplode("passages").alias("at", "p")).select(
        "conv", "turn", "mid", "at", F.col("p.level").alias("level"), _normal(F.col("p.text")).alias("norm"), _units(F.col("p.text")).alias("units")
    ).filter("norm <> ''").distinct()
    # a passage may be a whole message or any line or sentence of it; each distinct text keeps its first writer
    written = (
        parsed.join(passages.select("conv").distinct(), "conv", "left_semi")
        .select("conv", "turn", F.explode(_units(F.col("own"))).alias("unit"))
        .groupBy("conv", F.sha2("unit", 256).alias("hash"))
        .agg(F.min("turn").alias("origin"))
    )
    whole = passages.withColumn("hash", F.sha2("norm", 256)).join(written, ["conv", "hash"], "left")
    linked = whole.filter("origin is not null and origin < turn").select("mid", "at", "level", "origin")
    # several lines or sentences of a longer message: the writer of the longest known one, the first of equal length
    rest = whole.filter("origin is null or origin >= turn").select("conv", "turn", "mid", "at", "level", F.posexplode("units").alias("k", "unit"))
    by_unit = (
        rest.select("conv", "turn", "mid", "at", "level", "k", (-F.length("unit")).alias("short"), F.sha2("unit", 256).alias("hash"))
        .join(written, ["conv", "hash"]).filter("origin < turn")
        .groupBy("mid", "at", "level").agg(F.min(F.struct("short", "k", "origin"))["origin"].alias("origin"))
    )
    origins = linked.unionByName(by_unit)
    answers = origins.groupBy("mid").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "at", "origin"))["origin"].alias("parent_turn"))
    with_parent = staged(parsed.join(answers, "mid", "left"), "answers")
    paths = _paths(with_parent)
    parent = paths.select("conv", F.col("turn").alias("parent_turn"), "path")
    order = F.when(F.col("parent_turn").isNull(), F.array("turn")).otherwise(F.concat(F.coalesce("path", F.array("parent_turn")), F.array("turn")))
    return with_parent.join(parent, ["conv", "parent_turn"], "left").select(
        "row", "own", F.size("passages").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn", order.alias("order_key")
    )


def _paths(messages: DataFrame) -> DataFrame:
    """For messages with a parent, the turns from the thread's first message down, by doubling: log(depth) rounds."""
    steps = messages.filter("parent_turn is not null").groupBy("conv", "turn").agg(F.min("parent_turn").alias("top"))
    state = staged(steps.withColumn("path", F.array("top", "turn")), "paths")
    while not state.isEmpty():
        up = state.select("conv", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("path").alias("above"))
        grown = state.join(up, ["conv", "top"], "left").select(
            "conv", "turn", F.coalesce("next", "top").alias("top"),
            F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("above", F.slice("path", 2, 1 << 30))).alias("path"),
            F.col("next").isNotNull().alias("moved"),
        )
        grown = staged(grown, "paths")
        state = grown.drop("moved")
        if grown.filter("moved").isEmpty():
            break
    return state
