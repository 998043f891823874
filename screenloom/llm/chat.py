"""Chat formatting by perspective rotation.

Every participant of a dialogue gets the whole dialogue rendered with them as the assistant and everybody else as a named
user, and a mask of what the assistant says.  A long dialogue is cut into segments of a fixed number of turns, so a row stays
bounded whatever the length of the dialogue.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from screenloom.functions.ordered import ordinal

#: Turns in a segment.
SEGMENT = 64
# The markers of the format.
ASSISTANT, USER, CLOSE, END = "<|assistant|>\n", "<|user name=", "|>\n", "<|end|>\n"
NOBODY = "unknown"
#: Dialogues with more turns are numbered by ranges instead of one window.
ONE_WINDOW = 100_000


def escaped(text: Column) -> Column:
    """One more backslash between ``<`` and ``|``, so that no text holds a marker; taking one away restores it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, said``: turns in order as structs ``at, name, text``, at most ``segment`` of them in a row."""
    plain = turns.select(
        F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(NOBODY)).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    keys = F.xxhash64("name", "text").alias("tie")
    placed = ordinal(plain.select("*", keys), ["conv_id"], ["turn", "name", "tie"], "at", limit=ONE_WINDOW)
    part = F.floor(F.col("at") / segment).cast("bigint")
    return placed.groupBy("conv_id", part.alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("at", "name", "text"))).alias("said")
    )


def rendered(said: Column, me: Column) -> Column:
    """``text`` and ``mask``: the rendered turns, and ``start:end`` (code points) of what ``me`` says, end marker included."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("text"), F.array().cast("array<string>").alias("mask"))

    def step(acc, t):
        mine = t["name"] == me
        head = F.when(mine, F.lit(ASSISTANT)).otherwise(F.concat(F.lit(USER), F.regexp_replace(escaped(t["name"]), r"[\r\n]", " "), F.lit(CLOSE)))
        body = F.concat(escaped(t["text"]), F.lit(END))
        start = acc["at"] + F.length(head)
        # the line break behind the end marker is not learnt
        stop = start + F.length(body)
        span = F.array(F.concat_ws(":", start, stop - 1))
        return F.struct(
            stop.alias("at"), F.concat(acc["text"], head, body).alias("text"),
            F.when(mine, F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"),
        )

    return F.aggregate(said, begin, step, lambda a: F.struct(a["text"].alias("text"), F.array_join(a["mask"], ",").alias("mask")))


def rotate(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, perspective, segment, n_turns, n_own, text, mask``: one row for every participant and segment.

    ``turns`` needs ``conv_id``, ``turn``, ``role`` (the speaker's name) and ``text``; other columns are ignored.  Turns go by
    number, nulls first, then by name, then by a hash of name and text; repeated rows are said repeatedly.  A null name is
    ``unknown``, a null text empty, and turns without ``conv_id`` form one dialogue.  A participant who is silent in a segment
    has an empty mask there.  An empty table gives no rows.
    """
    cut = segments(turns, segment)
    names = turns.select(F.col("conv_id").alias("_conv"), F.coalesce(F.col("role").cast("string"), F.lit(NOBODY)).alias("perspective")).distinct()
    seen = cut.join(names, F.col("conv_id").eqNullSafe(F.col("_conv")))
    made = seen.select(
        "conv_id", "perspective", "segment", F.size("said").cast("bigint").alias("n_turns"),
        F.size(F.filter("said", lambda t: t["name"] == F.col("perspective"))).cast("bigint").alias("n_own"),
        rendered(F.col("said"), F.col("perspective")).alias("r"),
    )
    return made.select("conv_id", "perspective", "segment", "n_turns", "n_own", "r.text", "r.mask")
