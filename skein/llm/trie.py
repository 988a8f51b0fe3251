"""Prefix trie of conversations by fixed-length block hashing.

A turn is a digest. Four turns in a row are a block with a digest of its own.
The digests of a conversation's successive blocks, chained from its start, give
every block the state it starts in: conversations whose blocks start in one
state share all turns before it. Chains of long conversations are built in
levels of 32, so that no task walks a whole conversation.

Conversations are grouped by (state, block digest) first, copies becoming one
counted row. Where all blocks that start in a state are equal, each of their
turns is a node with the members of the group; only where blocks diverge are
they cut into turns and grouped turn by turn.

Each conversation owns the nodes whose smallest member it is, a run that ends
its path. Sums over a subtree are then sums over the members of its top: every
turn of a member counts, less what the members own. No node visits another.

Defined cases: a null role or text is empty; a null turn comes first; turns of
equal number are ordered by the digest of role and text; rows without a conv_id
are left out; rows that repeat are turns of their own; an empty table has no
nodes, not even a root; columns other than conv_id, turn, role and text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded, text_or_empty
from skein.llm.ranks import ranked
from skein.session import materialise

#: turns of a block
BLOCK = 4
#: runs that a level of the chain joins
FAN = 32
#: ids of a piece when the ends of a node are hashed
PIECE = 1024
#: bytes 0x20 and 0x09-0x0D part words
WORD = r"[^\x20\x09-\x0D]+"

#: every EVERY-th conversation lends its first turns to those after it
EVERY = 20
#: at most this many turns, less one, are lent
HEADS = 4


def _root() -> Column:
    """State before the first turn."""
    return F.lit(bytes(32))


def _sha(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, rank (from 0), size, digest and words of every turn."""
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        _sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return ranked(rows, ["conv_id"], ["turn", "digest"], "trie-turns").drop("turn")


def rebuilt(rows: DataFrame, every: int = EVERY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, digest, words) and ids of conversations whose first turns are another's.

    Conversation c takes the first h = crc32(c) % heads turns of c - c % every,
    as far as there are any, and then its own turns after its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = rows.filter("rank = 0").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("_base"))
    lent = rows.filter(F.col("rank") < heads - 1).groupBy(F.col("conv_id").alias("_lender"))
    lent = lent.agg(F.sort_array(F.collect_list(F.struct("rank", "digest", "words"))).alias("lent"))
    taken = F.when(F.col("h") > 0, F.slice("lent", F.lit(1), F.greatest("h", F.lit(1))))
    convs = first.join(lent, F.col("_base") == F.col("_lender"), "left")
    convs = materialise(convs.select("conv_id", "h", F.coalesce(taken, F.array().cast("array<struct<rank:bigint,digest:binary,words:bigint>>")).alias("taken")), "trie-convs")
    heads_of = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", F.col("t.rank").alias("pos"), "t.digest", "t.words")
    short = convs.filter(F.size("taken") < F.col("h")).select("conv_id", (F.col("h") - F.size("taken")).alias("back"))
    own = rows.filter(F.col("rank") >= h).join(bounded(short, short.count(), 64), "conv_id", "left")
    own = own.select("conv_id", (F.col("rank") - F.coalesce("back", F.lit(0))).alias("pos"), "digest", "words")
    return heads_of.unionByName(own), convs.select("conv_id")


def _states(runs: DataFrame, level: int = 0) -> DataFrame:
    """conv_id, at, state, end and before of runs (conv_id, at, digest, words, full).

    state: digest of all runs of the conversation before this one; end: with this one; before: words before it.
    A run is full if nothing but the end of the conversation could make it longer.
    """
    up = F.floor(F.col("at") / FAN).cast("long")
    groups = runs.groupBy("conv_id", up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "digest", "words", "full"))).alias("runs"))
    if (runs.agg(F.max("at")).first()[0] or 0) < FAN:
        groups = groups.select("*", _root().alias("start"), F.lit(None).cast("binary").alias("over"), F.lit(0).cast("long").alias("base"))
    else:
        groups = materialise(groups, f"trie-level-{level}")
        last = F.element_at("runs", -1)
        upper = groups.select(
            "conv_id", F.col("up").alias("at"), _sha(_joined(F.col("runs.digest"))).alias("digest"),
            F.aggregate("runs.words", F.lit(0).cast("long"), lambda a, w: a + w).alias("words"),
            ((F.size("runs") == FAN) & last["full"]).alias("full"),
        )
        above = _states(materialise(upper, f"trie-runs-{level}"), level + 1)
        groups = groups.join(
            above.select("conv_id", F.col("at").alias("up"), F.col("state").alias("start"), F.col("end").alias("over"), F.col("before").alias("base")),
            ["conv_id", "up"],
        )
        groups = groups.withColumn("over", F.when((F.size("runs") == FAN) & last["full"], F.col("over")))
    step = F.struct(F.col("start").alias("state"), F.col("base").alias("before"))
    chain = F.aggregate(
        "runs", F.array(step),
        lambda a, r: F.concat(a, F.array(F.struct(
            _sha(F.concat(F.element_at(a, -1)["state"], r["digest"])).alias("state"),
            (F.element_at(a, -1)["before"] + r["words"]).alias("before"),
        ))),
    )
    rows = groups.select("conv_id", "runs", "over", chain.alias("chain"))
    rows = rows.select("conv_id", "runs", "over", "chain", F.posexplode("runs").alias("i", "run"))
    following = F.get("chain", F.col("i") + 1)["state"]
    return rows.select(
        "conv_id", "run.at", F.get("chain", F.col("i"))["state"].alias("state"),
        F.when(F.col("i") == F.size("runs") - 1, F.coalesce("over", following)).otherwise(following).alias("end"),
        F.get("chain", F.col("i"))["before"].alias("before"),
    )


def blocks(rows: DataFrame) -> DataFrame:
    """conv_id, at, digest, turns (prefix digest and words of each), words, state, end, before of every block."""
    cut = rows.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).cast("long").alias("at"))
    cut = cut.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("t"))
    upto = F.transform(
        F.col("t"), lambda x, i: F.struct(_sha(_joined(F.slice(F.col("t.digest"), F.lit(1), i + 1))).alias("digest"), x["words"].alias("words"))
    )
    cut = materialise(cut.select("conv_id", "at", upto.alias("turns")), "trie-cut")
    runs = cut.select(
        "conv_id", "at", F.element_at("turns", -1)["digest"].alias("digest"),
        F.aggregate("turns.words", F.lit(0).cast("long"), lambda a, w: a + w).alias("words"), (F.size("turns") == BLOCK).alias("full"),
    )
    placed = cut.join(_states(runs), ["conv_id", "at"])
    digest = F.element_at("turns", -1)["digest"].alias("digest")
    return materialise(placed.select("conv_id", "at", digest, "turns", "state", "end", "before"), "trie-blocks")


def _cells(rows: DataFrame, *sums: str) -> DataFrame:
    """Blocks grouped by state and digest: members, the smallest one with its `top`, and sums."""
    same = [F.first(c).alias(c) for c in ("at", "turns", "end", "before")]
    return rows.groupBy("state", "digest").agg(
        *same, F.count(F.lit(1)).alias("n"), F.min(F.struct("conv_id", "top")).alias("owner"), *[F.sum(c).alias(c) for c in sums]
    )


def _diverging(cells: DataFrame) -> DataFrame:
    """States, the root's aside, in which blocks of more than one digest start."""
    inner = cells.filter(F.col("state") != _root())
    return inner.groupBy("state").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("state", F.lit(True).alias("split"))


def _nodes(cells: DataFrame, split: DataFrame, *sums: str) -> DataFrame:
    """node, parent, depth, words, before, n, owner and sums; blocks are refined to turns only where they diverge."""
    first = cells.filter(F.col("state") == _root()).withColumn("split", F.lit(True))
    later = cells.filter(F.col("state") != _root()).join(split, "state", "left").withColumn("split", F.col("split").isNotNull())
    every = first.unionByName(later.select(first.columns))
    named = F.transform(
        F.col("turns"),
        lambda t, i: F.struct(
            F.when(i == F.size("turns") - 1, F.col("end")).otherwise(_sha(F.concat(F.col("state"), t["digest"]))).alias("node"),
            (F.col("at") * BLOCK + i + 1).alias("depth"), t["words"].alias("words"),
            (F.col("before") + F.aggregate(F.slice(F.col("turns.words"), F.lit(1), i), F.lit(0).cast("long"), lambda a, w: a + w)).alias("before"),
        ),
    )
    rows = every.select("state", "split", "n", "owner", *sums, named.alias("named"))
    rows = rows.select("*", F.posexplode("named").alias("i", "at"))
    parent = F.when(F.col("i") == 0, F.col("state")).otherwise(F.get("named", F.col("i") - 1)["node"])
    rows = rows.select("split", "at.node", parent.alias("parent"), "at.depth", "at.words", "at.before", "n", "owner", *sums)
    merged = rows.filter("split").groupBy("node", "parent", "depth", "words", "before").agg(
        F.sum("n").alias("n"), F.min("owner").alias("owner"), *[F.sum(c).alias(c) for c in sums]
    )
    return rows.filter("NOT split").drop("split").unionByName(merged)


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 over (node, conv_id): ids ascending, comma-joined; a hot node is cut into pieces and hashed as a stream."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, node, ids = 0, None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([node], pa.binary()), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([",".join(map(str, ids))])],
                ["node", "part", "seq", "ids"],
            )

        part = 0
        for batch in batches:
            for at, conv, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (at != node or len(ids) == PIECE):
                    yield piece()
                    seq, ids = seq + 1, []
                node = at
                ids.append(conv)
        if ids:
            yield piece()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for at, ids in zip(batch.column(0), batch.column(1), strict=True):
                at = at.as_py()
                if at == node:
                    state.update(b",")
                else:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = at, sha256()
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    dealt = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").select("node", "conv_id", F.spark_partition_id().alias("part"))
    pieces = dealt.mapInArrow(cut, "node binary, part int, seq long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "ids").mapInArrow(fold, "node binary, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations `convs` (conv_id), whose turns are `rows` (conv_id, pos, digest, words).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    placed = blocks(rows)
    plain = materialise(_cells(placed.withColumn("top", F.lit(0).cast("long"))), "trie-cells")
    split = materialise(_diverging(plain), "trie-split")
    nodes = materialise(_nodes(plain, split).withColumn("owner", F.col("owner.conv_id")), "trie-nodes")
    children = materialise(nodes.groupBy(F.col("parent").alias("_parent")).agg(F.count(F.lit(1)).alias("n_children")), "trie-children")

    leaf = F.max(F.when(F.col("_parent").isNull(), 1).otherwise(0)).cast("long")
    owned = nodes.join(children, F.col("node") == F.col("_parent"), "left").groupBy(F.col("owner").alias("_owner"))
    owned = owned.agg(F.sum("words").alias("own"), F.min("before").alias("top"), leaf.alias("leaf"))
    sums = F.aggregate("turns.words", F.lit(0).cast("long"), lambda a, w: a + w)
    whole = placed.groupBy(F.col("conv_id").alias("_conv")).agg(F.max(F.col("before") + sums).alias("all"), F.max_by("end", "at").alias("end"))
    zero = F.lit(0).cast("long")
    values = convs.join(whole, F.col("conv_id") == F.col("_conv"), "left").join(owned, F.col("conv_id") == F.col("_owner"), "left").select(
        "conv_id", F.coalesce("end", _root()).alias("end"), F.coalesce("top", zero).alias("top"), F.coalesce("leaf", zero).alias("leaf"),
        (F.coalesce("all", zero) - F.coalesce("own", zero)).alias("shared"),
    )
    values = materialise(values, "trie-values")

    summed = _cells(placed.join(values.drop("end"), "conv_id"), "shared", "leaf")
    found = _nodes(summed, split, "shared", "leaf")
    total = values.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("conv_id", zero.alias("top"))).alias("owner"), F.sum("shared").alias("shared"), F.sum("leaf").alias("leaf"),
    ).filter("n > 0")
    root = total.select(
        _root().alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("words"), zero.alias("before"),
        "n", "owner", "shared", F.greatest("leaf", F.lit(1)).cast("long").alias("leaf"),
    )
    least = values.agg(F.min("conv_id")).first()[0]
    above = nodes.select(F.col("node").alias("_above"), F.col("owner").alias("_above_conv"))
    below = found.filter(F.col("parent") != _root()).join(above, F.col("parent") == F.col("_above"), "left").drop("_above")
    top = found.filter(F.col("parent") == _root()).withColumn("_above_conv", F.lit(least).cast("long"))
    every = below.unionByName(top).unionByName(root.withColumn("_above_conv", F.lit(None).cast("long")))
    ends = _hashed_ends(values.select(F.col("end").alias("node"), "conv_id")).withColumnRenamed("node", "_ended")
    every = every.join(children, F.col("node") == F.col("_parent"), "left").join(ends, F.col("node") == F.col("_ended"), "left")
    return every.select(
        F.col("owner.conv_id").alias("conv_id"), "depth", F.col("_above_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"), F.col("leaf").alias("n_leaves"),
        (F.col("shared") - F.col("n") * F.col("before") + F.col("before") - F.col("owner.top")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of `conversations` whose first turns are exchanged as `rebuilt` states."""
    return trie(*rebuilt(turns(conversations)))
