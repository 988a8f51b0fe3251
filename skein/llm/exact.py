"""Exact dedup with an extendible-hash index kept on shared files.

Texts hash to 64-bit keys. A directory of `2**depth` key prefixes points to
buckets, each a range of keys. Entries go to the owner task of their bucket,
which merges equal ones to links, sorts them by key and writes the bucket file. A
bucket that comes out overfull splits: the directory doubles where it must, and a
further pass reads and writes that bucket alone. Links with equal keys form a
chain; owners of the same buckets compare whole texts byte by byte before
texts count as equal.

Copies that one task saw become one entry before they are sent, so an owner gets
a row per task of a text that fills a third of all rows. All of it is DataFrame
work: the driver sees row counts and the directory (at most `2**MAX_DEPTH` numbers).

Defined cases: a null text is the empty text; a null doc_id takes part and is
kept only if its whole group has no id; of rows repeated with one doc_id and
text exactly one is kept; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded, fresh, text_or_empty
from skein.session import materialise, shared_folder

#: links a bucket holds before it splits
CAPACITY = 16_384
#: bits of the largest directory; buckets at that depth only grow longer
MAX_DEPTH = 18


def prefix(key: Column, depth: int) -> Column:
    """The first `depth` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


class Index:
    """Directory and bucket files of one index on a shared folder.

    A bucket is named by its prefix behind a leading one bit: bucket b splits
    into 2b and 2b + 1. `slots` holds the bucket of every prefix of `depth` bits.
    """

    def __init__(self, spark: SparkSession, path: str, depth: int = 0):
        self.spark, self.path, self.depth, self.passes = spark, path, depth, 0
        self.slots = list(range(1 << depth, 2 << depth))

    def bucket(self, key: Column) -> Column:
        """The bucket that the directory gives a key."""
        slot = prefix(key, self.depth).cast("int") + 1
        return F.element_at(F.from_json(F.lit(json.dumps(self.slots)), "array<int>"), slot)

    def split(self, overfull: dict[int, int]) -> None:
        """Split each bucket into `2**overfull[bucket]`, doubling the directory as often as that needs."""
        deepest = max(b.bit_length() - 1 + levels for b, levels in overfull.items())
        while self.depth < deepest:
            self.slots = [b for b in self.slots for _ in range(2)]
            self.depth += 1
        for slot, b in enumerate(self.slots):
            if b in overfull:
                local = b.bit_length() - 1 + overfull[b]
                self.slots[slot] = 1 << local | slot >> (self.depth - local)

    def owned(self, rows: DataFrame) -> DataFrame:
        """Rows at the owner tasks of their buckets."""
        return rows.withColumn("bucket", self.bucket(F.col("key"))).repartition(max(1, len(set(self.slots))), "bucket")

    def _store(self, entries: DataFrame) -> DataFrame:
        """Owners merge their entries to links, sort them and write; the links of this pass."""
        links = self.owned(entries).groupBy("bucket", "key", "sha").agg(
            F.sum("n").alias("n"),
            F.max("keep_id").alias("keep_id"),
            F.coalesce(F.max_by("keep_row", "keep_id"), F.min("keep_row")).alias("keep_row"),
        )
        at = f"{self.path}/buckets/pass={self.passes}"
        links.sortWithinPartitions("bucket", "key", "sha").write.parquet(at)
        self.passes += 1
        return self.spark.read.schema(links.schema).parquet(at)

    def fill(self, entries: DataFrame, capacity: int, max_depth: int) -> DataFrame:
        """Store (key, sha, n, keep_id, keep_row) entries; splits until no bucket is overfull. Returns the links."""
        links = self._store(entries)
        stored = links
        while True:
            # a bucket of one key, or of the finest prefix, cannot split
            sizes = links.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
            found = sizes.filter((F.col("n") > capacity) & (F.col("a") < F.col("b"))).select("bucket", "n").collect()
            over = {}
            for r in found:
                levels = min(max_depth - (r["bucket"].bit_length() - 1), math.ceil(math.log2(r["n"] / capacity)))
                if levels > 0:
                    over[r["bucket"]] = levels
            if not over:
                break
            self.split(over)
            full = self.spark.createDataFrame([(b,) for b in over], "bucket int")
            # only the overfull buckets are read again; their old links no longer lie where the directory points
            links = self._store(links.join(bounded(full, len(over), 16), "bucket", "left_semi").drop("bucket"))
            stored = stored.unionByName(links)
        self.spark.createDataFrame([(n, b) for n, b in enumerate(self.slots)], "slot int, bucket int").withColumn(
            "depth", F.lit(self.depth)
        ).write.parquet(f"{self.path}/directory")
        return stored.filter(F.col("bucket") == self.bucket(F.col("key")))


def exact_groups(
    docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_bits: int = 64
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Of equal texts the row with the largest doc_id is kept. `key_bits` shortens
    the keys, which makes chains of different texts (for tests).
    """
    text = text_or_empty()
    key = F.shiftleft(F.xxhash64(text), 64 - key_bits) if key_bits < 64 else F.xxhash64(text)
    entries = materialise(
        docs.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            key.alias("key"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
        ),
        "dedup-entries",
    )
    spark = docs.sparkSession
    # copies that one task saw become one entry
    local = materialise(
        entries.groupBy(F.shiftright("row", 33).alias("task"), "key", "sha").agg(
            F.count(F.lit(1)).alias("n"),
            F.max("doc_id").alias("keep_id"),
            F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row"),
        ).drop("task"),
        "dedup-local",
    )
    depth = min(max_depth, max(0, math.ceil(math.log2(max(1, local.count() / capacity)))))
    index = Index(spark, f"{shared_folder(spark)}/dedup-index-{uuid.uuid4().hex}", depth)
    links = index.fill(local, capacity, max_depth)

    several = links.filter("n > 1")
    n_repeated = several.count()
    # whole texts go to the owners only where a key repeats, one per task and text
    texts = docs.select(key.alias("key"), text.alias("text")).join(
        bounded(several.select("key").distinct(), n_repeated, 72), "key", "left_semi"
    )
    texts = texts.groupBy(F.spark_partition_id().alias("task"), "key", "text").agg(F.count(F.lit(1)).alias("equal"))
    # the owner of a chain compares its texts byte by byte: grouping by the text does that
    compared = index.owned(texts).groupBy("bucket", "key", "text").agg(F.sum("equal").alias("equal"))
    compared = compared.groupBy("bucket", "key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")).agg(
        F.count(F.lit(1)).alias("texts"), F.max("equal").alias("equal")
    )
    checked = several.join(compared.drop("bucket"), ["key", "sha"], "left")
    same = F.coalesce((F.col("texts") == 1) & (F.col("equal") == F.col("n")), F.lit(False))
    checked = checked.select(
        "key", "sha",
        # two texts under one key and digest would share an address: stop, never merge them
        F.when(same, F.col("n")).otherwise(F.raise_error(F.lit("texts differ under one digest"))).alias("n"),
        "keep_id", "keep_row",
    )
    groups = materialise(checked, "dedup-groups")

    alone = links.filter("n = 1").select(
        F.col("keep_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    members = entries.join(bounded(groups, n_repeated, 160), ["key", "sha"]).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "sha"
    )
    return alone.unionByName(members).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """Rows of `docs` that stay, with all their columns: one row of each group of equal texts."""
    digest, known, sha = fresh(docs, "_text_sha256", "_id", "_sha")
    groups = materialise(exact_groups(docs, **options).select("doc_id", "kept", "text_sha256"), "dedup-decisions")
    ids = groups.groupBy(F.col("doc_id").alias(known), F.col("text_sha256").alias(sha)).agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")
    )
    moved = materialise(ids.filter(~F.col("kept") | (F.col("n") > 1)), "dedup-moved")
    n_moved, n_again = moved.count(), moved.filter("kept").count()
    marked = docs.withColumn(digest, F.sha2(text_or_empty().cast("binary"), 256))

    def on(side: DataFrame):
        return F.col("doc_id").eqNullSafe(side[known]) & (F.col(digest) == side[sha])

    side = bounded(moved.select(known, sha), n_moved, 160)
    stay = marked.join(side, on(side), "left_anti")
    if n_again:  # rows that repeat both id and text
        again = moved.filter("kept").select(known, sha)
        stay = stay.unionByName(marked.join(again, on(again), "left_semi").dropDuplicates(["doc_id", digest]))
    return stay.drop(digest)
