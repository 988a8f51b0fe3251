"""Quotation linking: reply-ordered conversations from messages that quote each other.

Lines are parsed into nested quote levels. Every quoted line and every own line
is normalised and hashed; a quoted line belongs to the latest earlier message
of its conversation that wrote it itself, else to the earliest message of an
earlier conversation that did. The shallowest level decides what a
message replies to (the latest such message). Replies form trees; their roots
are found by pointer doubling, and messages come out without quotes, in an order
in which every reply follows what it answers.

A line that very many messages share costs one row per bucket of turns and per
map task: originals are reduced before they meet the quotes, and no group of
lines or replies is gathered.

Defined cases: a null or empty text is a message without lines; a null
conversation or turn stands for itself: such a message links to nothing and is its own
root; rows that repeat conversation and turn are one message, the one with the
smallest text; lines without a letter or digit link nothing; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import pieces
from skein.operators.ordered import chunk_of, ordinal
from skein.session import materialise

_MARK = re.compile(r"^[ \t]*>")
_GAPS = re.compile(r"[\W_]+")


def level_of(line: str) -> tuple[int, str]:
    """Quote level of a line and the line without its marks."""
    level = 0
    while m := _MARK.match(line):
        line = line[m.end() :]
        level += 1
    return level, line[1:] if level and line[:1] == " " else line


def line_hash(line: str) -> bytes | None:
    """128-bit hash of the letters and digits of a line; None without any."""
    plain = _GAPS.sub(" ", line.lower()).strip()
    return hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest() if plain else None


def parse(text: str) -> tuple[str, list[bytes], list[tuple[int, bytes]]]:
    """Own text, hashes of own lines, and (level, hash) of quoted lines; each hash once (per level)."""
    own, written, quoted = [], {}, {}
    for line in text.splitlines():
        level, rest = level_of(line)
        mark = line_hash(rest)
        if level:
            if mark:
                quoted.setdefault((level, mark))
        else:
            own.append(line)
            if mark:
                written.setdefault(mark)
    return "\n".join(own).strip("\n"), list(written), list(quoted)


_QUOTE = pa.struct([("level", pa.int32()), ("hash", pa.binary())])


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, own_text, written (hashes), quoted (level, hash) of every message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [parse(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.list_(pa.binary())),
                    pa.array([[{"level": a, "hash": b} for a, b in x[2]] for x in out], pa.list_(_QUOTE)),
                ],
                ["conv_id", "turn", "own_text", "written", "quoted"],
            )

    one = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    kinds = [messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    return one.mapInArrow(
        run, f"conv_id {kinds[0]}, turn {kinds[1]}, own_text string, written array<binary>, quoted array<struct<level:int,hash:binary>>"
    )


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash, to_conv, to_turn of every quoted line that has an original."""
    known = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    written = known.select("conv_id", "turn", F.explode("written").alias("hash"))
    quoted = known.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.hash")
    # only lines that are quoted somewhere can be originals
    written = written.join(quoted.select("hash").distinct(), "hash", "left_semi")
    written = materialise(written.select("conv_id", "turn", "hash"), "quotes-written")
    events = written.select("conv_id", "turn", "hash", F.lit(None).cast("int").alias("level"), F.col("turn").alias("own")).unionByName(
        quoted.select("conv_id", "turn", "hash", "level", F.lit(None).cast(known.schema["turn"].dataType).alias("own"))
    ).withColumn("part", chunk_of("turn"))
    key = ["conv_id", "hash"]
    earlier = Window.partitionBy(*key, "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy(*key, "part").agg(F.max("own").alias("most"))
    carried = carried.select(*key, "part", F.max("most").over(before).alias("carried"))
    found = events.withColumn("near", F.max("own").over(earlier)).filter("level IS NOT NULL")
    found = found.join(carried, [*key, "part"]).select(
        "conv_id", "turn", "level", "hash", F.coalesce("near", "carried").alias("to_turn")
    )
    found = materialise(found, "quotes-found")
    inside = found.filter("to_turn IS NOT NULL").select("conv_id", "turn", "level", "hash", F.col("conv_id").alias("to_conv"), "to_turn")
    first = written.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    outside = found.filter("to_turn IS NULL").drop("to_turn").join(first, "hash").filter(F.col("first.conv_id") < F.col("conv_id"))
    return inside.unionByName(
        outside.select("conv_id", "turn", "level", "hash", F.col("first.conv_id").alias("to_conv"), F.col("first.turn").alias("to_turn"))
    )


def roots(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """id, root, depth from (id, parent); a root has a null parent.

    Each round doubles the reach, and only of messages that haven't met their
    root yet: a long thread costs more rounds of its own, none of the others'.
    """
    top = F.col("parent").isNull()
    state = parents.select(
        "id", F.coalesce("parent", "id").alias("up"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), top.alias("done")
    )
    state = materialise(state, "quotes-up-0")
    settled, going = state.filter("done"), state.filter("NOT done")
    for n in range(1, rounds + 1):
        if going.isEmpty():
            return settled.select("id", F.col("up").alias("root"), "depth")
        at = settled.unionByName(going).select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        state = going.select("id", "up", "depth").join(at, F.col("up") == F.col("_id")).select(
            "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done")
        )
        state = materialise(state, f"quotes-up-{n}")
        settled, going = settled.unionByName(state.filter("done")), state.filter("NOT done")
    raise RuntimeError("replies did not settle")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message without quotes, what it answers, and its place in its conversation.

    conv_id, turn, parent_conv, parent_turn, root_conv, root_turn, depth,
    position (from 0, replies after what they answer), n_quoted, n_linked, own_text.
    """
    rows = materialise(parsed(messages), "quotes-messages")
    found = links(rows)
    # the shallowest level decides, then the latest message
    rank = F.struct((-F.col("level")).alias("level"), F.col("to_conv").alias("conv"), F.col("to_turn").alias("turn"))
    answers = found.groupBy("conv_id", "turn").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("n_linked"))
    joined = rows.join(answers, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.col("best.conv").alias("parent_conv"), F.col("best.turn").alias("parent_turn"),
        F.size("quoted").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "own_text",
    )
    joined = materialise(joined, "quotes-answers")
    me = F.struct("conv_id", "turn")
    parent = F.when(F.col("parent_turn").isNotNull(), F.struct(F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn")))
    whole = joined.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    tops = roots(whole.select(me.alias("id"), parent.alias("parent")))
    tops = tops.select(F.col("id.conv_id").alias("conv_id"), F.col("id.turn").alias("turn"), F.col("root.conv_id").alias("root_conv"), F.col("root.turn").alias("root_turn"), "depth")
    placed = ordinal(
        tops, ["root_conv", "root_turn"], ["conv_id", "turn"], F.struct("conv_id", chunk_of("turn").alias("part")), "position"
    )
    named = whole.join(placed, ["conv_id", "turn"])
    odd = joined.filter("conv_id IS NULL OR turn IS NULL").select(
        "*", F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("position")
    )
    return named.unionByName(odd).select(
        "conv_id", "turn", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth", "position", "n_quoted", "n_linked", "own_text"
    )


def as_mail(turns: DataFrame) -> DataFrame:
    """Turns of `conversations` as replies that quote the last line of the turn before, and below it of the one before that."""
    text = F.coalesce("text", F.lit(""))
    last = F.element_at(F.split(text, "\n"), -1)
    rows = turns.select("conv_id", "turn", text.alias("text"), last.alias("line"))
    lines = rows.groupBy("conv_id", "turn").agg(F.min("line").alias("line"))

    def back(k: int) -> DataFrame:
        return lines.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("line").alias(f"line{k}"))

    rows = rows.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    body = F.concat_ws(
        "\n",
        F.when(F.col("line2").isNotNull(), F.concat(F.lit("> > "), F.col("line2"))),
        F.when(F.col("line1").isNotNull(), F.concat(F.lit("> "), F.col("line1"))),
        "text",
    )
    return rows.select("conv_id", "turn", body.alias("text"))
