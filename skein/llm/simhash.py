"""SimHash near-dedup by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of `radius + 1` bits. For each
non-zero vector v, one table keys fingerprints on the positions whose vector
has odd parity with v. The vectors of any `radius` positions leave some v
orthogonal to them all, so two fingerprints that differ in at most `radius`
bits agree on the key of that table: no pair within the radius is missed.

Defined cases: a null text is the empty text, with fingerprint zero, linked
like any other; a null doc_id takes part but never names a component unless all
ids of the component are null; repeated rows each get a result row; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded, pieces
from skein.llm.components import components
from skein.session import materialise

#: differing bits of linked fingerprints
RADIUS = 2
#: words of a shingle
SHINGLE = 3
#: fingerprints of a bucket that are compared with each other; larger buckets meet through neighbours
SMALL_BUCKET = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(raw: bytes, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle, some tens of thousands at a time."""
    words = raw.translate(_LOWER).split()  # bytes.split cuts at 0x20 and 0x09-0x0D
    if not words:
        return
    hashed = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= width:
        yield np.array([hashed(line, 42)], dtype=np.uint64)
        return
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    for lo in range(0, len(words) - width + 1, 50_000):
        hi = min(lo + 50_000, len(words) - width + 1)
        spans = zip(starts[lo:hi], ends[lo + width - 1 : hi + width - 1], strict=True)
        yield np.fromiter((hashed(line[a : b - 1], 42) for a, b in spans), np.uint64, hi - lo)


def fingerprint_of(raw: bytes, width: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingle hashes (as unsigned number)."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(raw, width):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
        total += len(hashes)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (fp, as signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [fingerprint_of(raw or b"", width) for raw in batch.column(1).to_pylist()]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask per table."""
    vectors = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        for v in range(1, 1 << (radius + 1))
    ]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, small: int = SMALL_BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within `radius`.

    In a bucket of at most `small` fingerprints they are compared directly. In a larger
    one every fingerprint visits the values one flip away (for radius 2: any two
    linked ones have such a value in common, and all that meet in one are
    linked), so the work stays linear in the bucket.
    """
    if radius != 2:
        small = 1 << 62
    masks = covering_masks(radius)
    keys = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks)
    ])
    rows = fps.select("fp", F.explode(keys).alias("at")).select("fp", "at.t", "at.k")
    sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = materialise(rows.join(sizes, ["t", "k"]), "simhash-buckets")
    few = crowded.filter(F.col("n") <= small)
    a, b = few.select("t", "k", F.col("fp").alias("a")), few.select("t", "k", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = a.join(b, (a["t"] == b["t"]) & (a["k"] == b["k"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    if radius != 2:
        return pairs
    flips = F.element_at(
        F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks]),
        F.col("t") + 1,
    )
    visits = crowded.filter(F.col("n") > small).select(
        "t", "k", "fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("at")
    )
    meet = visits.groupBy("t", "at").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = visits.join(meet.select("t", "at", "b"), ["t", "at"]).select(F.col("fp").alias("a"), "b").filter("a <> b")
    return pairs.unionByName(stars)


def near_groups(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, small: int = SMALL_BUCKET) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row of `docs`."""
    prints = materialise(fingerprints(docs, width), "simhash-prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    joined = materialise(components(links(distinct.select("fp"), radius, small)), "simhash-joined")
    n_joined = joined.count()
    # only fingerprints with a link need a second look
    members = distinct.join(bounded(joined, n_joined, 72), F.col("fp") == F.col("node"))
    members = materialise(members.select("fp", "first", "component"), "simhash-members")
    named = members.groupBy("component").agg(F.min("first").alias("component_id"))
    members = members.join(bounded(named, n_joined, 72), "component").select("fp", "component_id")
    labels = distinct.join(bounded(materialise(members, "simhash-named"), n_joined, 72), "fp", "left")
    labels = labels.select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(bounded(labels, distinct.count(), 72), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

