"""Near copies by shingle sets: every pair with a Jaccard similarity of at least 0.8.

A text is the set of its 5-word shingles. All sets are ordered the same way:
frequent shingles last, else by hash. Two sets that are at least
0.8 alike have a common shingle among the first fifth (and one) of each, so those
are the keys: no pair is missed, whatever the sample says; it only decides how many
pairs are compared. Of the pairs that meet in a key, and whose sizes and places of the
key allow it, those go whose histograms of shingles (by hash, two to four a bin) have too
little in common; the rest is confirmed on the whole sets.

Keys that more than `SMALL_BUCKET` sets have are counted over all rows and put last too, with
those of the sample; sets that had one among their first get others. In a key all sets meet
one of them, in rounds with another one each, until a round finds few new links; after
that only sets that are still not in one component meet each other. Before that, pairs come from fingerprints of the sets and the covering masks
of `skein.llm.simhash`, and are confirmed like all others. A key that very many unlike sets share, all of them without rarer shingles, costs its
pairs.

Defined cases: a null text is the empty text, and empty texts are alike; a text of at most
five words is one shingle; a null doc_id takes part but always stays; rows are told apart
by id and text, so unlike texts under one id are judged one by one, and of near copies
under one id one stays; rows equal in both stay or go together; an empty table gives an
empty result; columns other than doc_id and text are carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded, forget_tables, fresh, pieces, sampled
from skein.llm.components import components
from skein.llm.simhash import shingle_hashes, signed
from skein.llm.simhash import links as covering_links
from skein.session import discard, gathered, materialise

#: words of a shingle
SHINGLE = 5
#: texts whose shingles are counted (expected number), the count that is frequent, and the most that are told apart
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 4000, 5, 200_000
#: rows that have a key, at most, before it counts as frequent
SMALL_BUCKET = 64
#: sets that the keys of a group of near copies choose among themselves to be met first, and rounds of that at most
PIVOTS, ROUNDS = 4, 5
#: share of all links that a round must find to be followed by another
LEAST_NEW = 0.02


def shingle_set(raw: bytes) -> np.ndarray:
    """Distinct shingle hashes of a text in ascending order."""
    parts = list(shingle_hashes(raw, SHINGLE))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_number(shingles: np.ndarray) -> int:
    """One signed number for a whole set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7) - (1 << 63)


def prefix(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set, one of which every set that is 0.8 alike has among its own first ones."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        often = frequent[at] == shingles
        shingles = np.concatenate([shingles[~often], shingles[often]])
    return shingles[: len(shingles) + 1 + -4 * len(shingles) // 5] if len(shingles) else shingles


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set: bit b is set if it is set in over half of the shingles (signed)."""
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(shingles), 50_000):
        part = shingles[lo : lo + 50_000].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return signed(int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big"))


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of fewer rows, in a worker that gives up the tables of other stages."""
    forget_tables()
    yield from pieces(batches, 128)


def histogram(shingles: np.ndarray) -> bytes | None:
    """Counts of the shingles by their lowest bits, a byte each; none if a count needs more."""
    bins = 1 << min(13, max(4, len(shingles).bit_length() - 2))
    counts = np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return None if counts.max(initial=0) > 255 else counts.astype(np.uint8).tobytes()


def most_common(a: bytes | None, b: bytes | None) -> int:
    """No fewer shingles than two sets with these histograms have in common."""
    if a is None or b is None:
        return 1 << 62
    bins = min(len(a), len(b))
    a, b = (np.frombuffer(x, np.uint8).reshape(-1, bins).sum(axis=0, dtype=np.int64) for x in (a, b))
    return int(np.minimum(a, b).sum())


def _raw(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.xxhash64(raw).alias("h"), raw.alias("raw"))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that several texts of a sample have, ascending."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for raw in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(raw).view(np.int64))], ["s"])

    some = _raw(docs).filter(sampled(share, "h")).select("raw").mapInArrow(run, "s long")
    counts = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    top = gathered(counts.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s"))["s"].to_numpy()
    return np.sort(top.astype(np.int64).view(np.uint64))


def _prints(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, text hash h, set number (node), fingerprint, set size n, histogram and prefix keys of rows (doc_id, h, raw)."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            sets = [shingle_set(raw) for raw in batch.column(2).to_pylist()]
            keys = [prefix(s, shared.value).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([set_number(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([histogram(s) for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "h", "node", "fp", "n", "histogram", "keys"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, h long, node long, fp long, n int, histogram binary, keys array<long>")


def _holding(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """Distinct h of rows with a key in `hot`."""
    shared = rows.sparkSession.sparkContext.broadcast(hot.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(keys).to_numpy())
            found = np.unique(owner[np.isin(keys.flatten().to_numpy(), shared.value)])
            yield batch.select([0]).take(pa.array(found))

    return rows.select("h", "keys").mapInArrow(run, "h long").distinct()


def prints(docs: DataFrame, crowded: int = SMALL_BUCKET) -> DataFrame:
    """Prefix keys and the rest of `_prints` for every row.

    Keys that more than `crowded` rows turn out to have, though the sample did not
    show them as frequent, are put last as well; rows with such a key get new ones.
    """
    frequent = frequent_shingles(docs)
    rows = materialise(_prints(_raw(docs), frequent), "near-prints")
    hot = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded)
    hot = hot.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).select("key").toArrow()["key"].to_numpy().astype(np.int64).view(np.uint64)
    hot = np.setdiff1d(hot, frequent)
    if not len(hot):
        return rows
    changed = materialise(_holding(rows, hot), "near-crowded")
    changed_side = bounded(changed, changed.count(), 40)
    anew = _prints(_raw(docs).join(changed_side, "h", "left_semi").select("doc_id", "h", "raw"), np.union1d(frequent, hot))
    both = materialise(rows.join(changed_side, "h", "left_anti").select(rows.columns).unionByName(anew), "near-prints")
    discard(rows, changed)
    return both


def plausible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose histograms leave room for a Jaccard similarity of 0.8."""
    some = rows.select("node", "n", "histogram").dropDuplicates(["node"])
    a = some.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("histogram").alias("ha"))
    b = some.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("histogram").alias("hb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            sizes, left, right = (batch.column(i).to_pylist() for i in (2, 3, 4))
            keep = [most_common(x, y) * 9 >= n * 4 for n, x, y in zip(sizes, left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, rows: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of sets with a Jaccard similarity of at least 0.8, from whole sets."""
    met = materialise(pairs.distinct(), f"near-{name}-met")
    pairs = materialise(plausible(met, rows), f"near-{name}-pairs")
    wanted = materialise(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), f"near-{name}-wanted")
    texts = rows.join(bounded(wanted, wanted.count(), 40), "node", "left_semi").groupBy("node").agg(F.min("h").alias("h")).select("h")
    texts = materialise(texts, f"near-{name}-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            sets = [shingle_set(raw) for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_number(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["node", "shingles"],
            )

    sets = _raw(docs).join(bounded(texts, texts.count(), 40), "h", "left_semi").dropDuplicates(["h"]).select("raw")
    sets = materialise(sets.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]), f"near-{name}-sets")
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    alike = F.size(F.array_intersect("sa", "sb")) * 9 >= (F.size("sa") + F.size("sb")) * 4
    found = materialise(both.filter(alike).select("a", "b"), f"near-{name}-links")
    discard(met, pairs, wanted, texts, sets)
    return found


def possible(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that meet in a key and may be alike by their sizes and by what can follow the key (their first common one)."""
    na, nb = F.col("na"), F.col("nb")
    most = F.lit(1) + F.least(na - F.col("ia"), nb - F.col("ib")) - 1
    near = (na * 5 >= nb * 4) & (nb * 5 >= na * 4) & (most * 9 >= (na + nb) * 4)
    return a.join(b, "key").filter(near)


def by_masks(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints the covering masks bring together.

    Of the sets with one fingerprint the smallest stands for it, and the others meet that one.
    """
    nodes = rows.select("node", "fp").distinct()
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    met = covering_links(first.select("fp")).distinct()
    a, b = first.select(F.col("fp").alias("a"), F.col("first").alias("na")), first.select(F.col("fp").alias("b"), F.col("first").alias("nb"))
    across = met.join(a, "a").join(b, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    inside = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = materialise(across.unionByName(inside), "near-masks")
    discard(first)
    return pairs


def links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets which a chain of pairs of at least 0.8 connects."""
    keys = rows.select("node", "n", F.posexplode("keys").alias("i", "key"))
    sizes = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1").select("key"), "near-keys")
    met = materialise(keys.join(bounded(sizes, sizes.count(), 40), "key").distinct(), "near-shared")
    discard(sizes)
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    sizes = materialise(sizes, "near-sizes")
    shared = materialise(met.join(bounded(sizes, sizes.count(), 56), "key"), "near-buckets")
    discard(met, sizes)
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("key", *[F.col(x).alias(y + s) for x, y in (("node", ""), ("n", "n"), ("i", "i"), ("c", "c"))])

    left, found, n_found = shared.withColumn("c", F.col("node")), None, 0
    for n in range(-1, ROUNDS):
        if n < 0:
            met = by_masks(rows)
        else:
            # keys that go together choose different pivots, so a set has several chances to meet its like
            order = F.xxhash64("node", F.pmod("key", F.lit(PIVOTS)), F.lit(n))
            pivots = left.groupBy("key").agg(F.min_by("node", order).alias("a")).withColumnRenamed("key", "_key")
            pivots = left.join(pivots, (F.col("key") == F.col("_key")) & (F.col("node") == F.col("a"))).select(left.columns)
            met = possible(side(pivots, "a"), side(left, "b")).filter("ca <> cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = confirmed(met, rows, docs, f"round-{n}")
        found = more if found is None else materialise(found.unionByName(more), "near-found")
        before, n_found = n_found, found.count()
        if n_found == before:
            if n < 0:
                continue
            break
        known = materialise(components(found), "near-known")
        named = shared.join(bounded(known, known.count(), 48), shared["node"] == known["node"], "left")
        named = materialise(named.select(shared["*"], F.coalesce(known["component"], shared["node"]).alias("c")), "near-named")
        # sets that are alone with another in a key have met it once a round of keys is over
        apart = (named if n < 0 else named.filter("met > 2")).groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
        apart = materialise(apart.filter("lo <> hi").select("key"), "near-apart")
        left = materialise(named.join(bounded(apart, apart.count(), 40), "key").select(*shared.columns, "c"), "near-left")
        discard(known, named, apart)
        # the rest compares what is left, so another round must be worth its jobs
        if n >= 0 and n_found - before < LEAST_NEW * n_found:
            break
    rest = possible(side(left, "a"), side(left, "b")).filter("a < b AND ca <> cb").select("a", "b")
    found = found.unionByName(confirmed(rest, rows, docs, "rest"))
    discard(shared)
    return found


def _members(docs: DataFrame, small: int) -> DataFrame:
    """doc_id, text hash h and component of every row."""
    rows = prints(docs, small)
    joined = materialise(components(links(rows, docs)), "near-joined")
    named = rows.join(bounded(joined, joined.count(), 48), "node", "left").select("doc_id", "h", F.coalesce("component", "node").alias("component"))
    named = materialise(named, "near-rows")
    discard(rows, joined)
    return named


def groups(docs: DataFrame, small: int = SMALL_BUCKET) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of the group) of every row."""
    rows = _members(docs, small)
    named = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    named = materialise(named.select("component", "component_id"), "near-named")
    return rows.join(bounded(named, named.count(), 48), "component", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, small: int = SMALL_BUCKET) -> DataFrame:
    """Rows of `docs` that stay: of each group the text with the smallest doc_id, and rows without an id."""
    rows = _members(docs, small).filter("doc_id IS NOT NULL")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = materialise(first.select("component", "first"), "near-first")
    known, text, own = fresh(docs, "_gone_id", "_gone_text", "_text_hash")
    gone = rows.join(bounded(first, first.count(), 64), "component").filter(F.struct("doc_id", "h") != F.col("first"))
    gone = materialise(gone.select(F.col("doc_id").alias(known), F.col("h").alias(text)).distinct(), "near-gone")
    marked = docs.select("*", F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias(own))
    same = (F.col("doc_id") == F.col(known)) & (F.col(own) == F.col(text))
    return marked.join(bounded(gone, gone.count(), 80), same, "left_anti").select(docs.columns)
