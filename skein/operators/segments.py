"""A stored search index that takes new messages without being rewritten.

The index is a set of immutable segments. A segment holds the postings of the messages
of one append, sorted by term, and one row per message with its length. A version
of the index is a small table that names its segments with their message counts and
lengths, and the deletions that hold for them; corpus totals are sums over that table.

Appending writes a segment, deleting writes the (segment, message) pairs that go, and
merging writes one segment in place of several of like size. Each ends with a new
version, written last and never over an older one, so a reader sees all of a change
or nothing, and of two writers at once one fails. Scores equal those of an index built
afresh from the messages that are left.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.search import DOC, WEIGHTS, Index, build_index, tokenised
from skein.session import materialise
from skein.sources.sinks import path_exists, remove_path

#: segments of like size that are merged into one
FAN = 8
#: deletions that a reader broadcasts
BROADCAST_ROWS = 200_000

_VERSION = "segment string, docs bigint, length bigint, dead bigint, deletions array<string>"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions, oldest first."""
    if not path_exists(spark, f"{folder}/versions"):
        return []
    found = spark.read.parquet(f"{folder}/versions").select("version").distinct()
    return sorted(r["version"] for r in found.collect())


def _rows(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, list[dict]]:
    known = versions(spark, folder)
    version = (known[-1] if known else 0) if version is None else version
    if version == 0:
        return 0, []
    rows = spark.read.schema(_VERSION).parquet(f"{folder}/versions/version={version}")
    return version, [r.asDict() for r in rows.collect() if r["segment"] is not None]


def _commit(spark: SparkSession, folder: str, version: int, rows: Sequence[Mapping]) -> int:
    """Make `rows` the next version; fails if another writer has made it already."""
    named = [tuple(r[c] for c in ("segment", "docs", "length", "dead", "deletions")) for r in rows] or [(None, 0, 0, 0, [])]
    table = spark.createDataFrame(named, _VERSION).coalesce(1)
    table.write.mode("errorifexists").parquet(f"{folder}/versions/version={version + 1}")
    return version + 1


def _write_segment(index_postings: DataFrame, docs: DataFrame, folder: str) -> dict:
    """Store a segment; the document in the range key lets a frequent term spread over several files."""
    spark, name = docs.sparkSession, uuid.uuid4().hex
    at = f"{folder}/segments/{name}"
    index_postings.repartitionByRange("term", *DOC).sortWithinPartitions("term", *DOC).write.parquet(f"{at}/postings")
    docs.select(*DOC, "dl").write.parquet(f"{at}/docs")
    total = spark.read.parquet(f"{at}/docs").agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
    return {"segment": name, "docs": total["docs"], "length": total["length"], "dead": 0, "deletions": []}


def append(messages: DataFrame, folder: str, fields: Sequence[str] = tuple(WEIGHTS), stem: bool = True) -> int:
    """Add messages that the index does not hold; only their segment is written. Returns the version."""
    spark = messages.sparkSession
    version, rows = _rows(spark, folder)
    return _commit(spark, folder, version, [*rows, _segment_of(messages, folder, fields, stem)])


def _segment_of(messages: DataFrame, folder: str, fields: Sequence[str], stem: bool) -> dict:
    return _write_segment(build_index(messages, fields, stem).postings, tokenised(messages, fields, stem), folder)


def _tagged(spark: SparkSession, folder: str, rows: Sequence[Mapping], part: str) -> DataFrame | None:
    """`part` of the segments with the segment's name."""
    if not rows:
        return None
    paths = [f"{folder}/segments/{r['segment']}/{part}" for r in rows]
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/segments/([0-9a-f]+)/", 1)
    return spark.read.parquet(*paths).select("*", name.alias("segment"))


def _deleted(spark: SparkSession, folder: str, rows: Sequence[Mapping]) -> DataFrame | None:
    """segment, session_id, msg_index of deleted messages of the segments."""
    names = sorted({d for r in rows for d in r["deletions"]})
    if not names:
        return None
    gone = spark.read.parquet(*[f"{folder}/deletions/{n}" for n in names])
    return gone.filter(F.col("segment").isin([r["segment"] for r in rows]))


def _alive(spark: SparkSession, folder: str, rows: Sequence[Mapping], part: str) -> DataFrame | None:
    """Rows of `part` of the segments without those of deleted messages; segments without deletions are not joined."""
    clean, marked = [r for r in rows if not r["dead"]], [r for r in rows if r["dead"]]
    kept = _tagged(spark, folder, clean, part)
    if marked:
        # Spark would go by the size of the files, which hold millions of deletions in a few MB
        few = sum(r["dead"] for r in marked) <= BROADCAST_ROWS
        gone = _deleted(spark, folder, marked).hint("broadcast" if few else "merge")
        left = _tagged(spark, folder, marked, part).join(gone, ["segment", *DOC], "left_anti")
        kept = left if kept is None else kept.unionByName(left)
    return kept


def delete(gone: DataFrame, folder: str) -> int:
    """Delete messages (session_id, msg_index) or, without msg_index, whole sessions. Later appends may bring them back."""
    spark = gone.sparkSession
    version, rows = _rows(spark, folder)
    return _commit(spark, folder, version, _without(gone, folder, rows))


def _without(gone: DataFrame, folder: str, rows: list[dict]) -> list[dict]:
    """`rows` after the deletion of `gone`, of which only messages still alive are written."""
    spark = gone.sparkSession
    docs = _alive(spark, folder, rows, "docs")
    if docs is None:
        return rows
    keys = [c for c in DOC if c in gone.columns]
    name = uuid.uuid4().hex
    path = f"{folder}/deletions/{name}"
    docs.join(gone.select(*keys).distinct(), keys, "left_semi").select("segment", *DOC, "dl").write.parquet(path)
    lost = spark.read.parquet(path).groupBy("segment").agg(F.count("*").alias("dead"), F.sum("dl").alias("length")).collect()
    lost = {r["segment"]: r for r in lost}
    out = []
    for r in rows:
        if r["segment"] in lost:
            at = lost[r["segment"]]
            r = r | {"docs": r["docs"] - at["dead"], "length": r["length"] - at["length"], "dead": r["dead"] + at["dead"], "deletions": [*r["deletions"], name]}
        out.append(r)
    return [r for r in out if r["docs"]]


def replace(messages: DataFrame, gone: DataFrame, folder: str, fields: Sequence[str] = tuple(WEIGHTS), stem: bool = True) -> int:
    """Delete and append in one version: a reader never sees a message twice or not at all."""
    spark = messages.sparkSession
    version, rows = _rows(spark, folder)
    return _commit(spark, folder, version, [*_without(gone, folder, rows), _segment_of(messages, folder, fields, stem)])


def to_merge(rows: Sequence[Mapping], fan: int = FAN) -> list[list[Mapping]]:
    """Groups of at least `fan` segments of one size class, or of any that are mostly deleted."""
    classes: dict[int, list[Mapping]] = {}
    for r in rows:
        classes.setdefault(int(math.log(max(1, r["docs"]), fan)), []).append(r)
    groups = [group for group in classes.values() if len(group) >= fan]
    taken = {r["segment"] for group in groups for r in group}
    return groups + [[r] for r in rows if r["segment"] not in taken and r["dead"] > r["docs"]]


def merge(spark: SparkSession, folder: str, fan: int = FAN) -> int:
    """Write one segment for each group of `to_merge`, without deleted messages. Returns the version."""
    version, rows = _rows(spark, folder)
    groups = to_merge(rows, fan)
    if not groups:
        return version
    merged = [
        _write_segment(_alive(spark, folder, group, "postings").drop("segment"), _alive(spark, folder, group, "docs"), folder) for group in groups
    ]
    gone = {r["segment"] for group in groups for r in group}
    return _commit(spark, folder, version, [*[r for r in rows if r["segment"] not in gone], *merged])


def read(spark: SparkSession, folder: str, version: int | None = None) -> Index:
    """The index of a version, the newest by default; stays readable while others write."""
    _, rows = _rows(spark, folder, version)
    if not rows:
        raise ValueError("the index holds no message")
    docs, length = sum(r["docs"] for r in rows), sum(r["length"] for r in rows)
    corpus = spark.createDataFrame([(docs, length / docs)], "docs bigint, avgdl double")
    return Index(_alive(spark, folder, rows, "postings").drop("segment"), corpus)


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Forget all but the last `keep` versions and remove what only the others name. No reader may still use those."""
    known = versions(spark, folder)
    kept = [r for v in known[-keep:] for r in _rows(spark, folder, v)[1]]
    for v in known[:-keep]:
        for r in _rows(spark, folder, v)[1]:
            if r["segment"] not in {k["segment"] for k in kept}:
                remove_path(spark, f"{folder}/segments/{r['segment']}")
            for d in r["deletions"]:
                if d not in {x for k in kept for x in k["deletions"]}:
                    remove_path(spark, f"{folder}/deletions/{d}")
        remove_path(spark, f"{folder}/versions/version={v}")


def rebuilt(spark: SparkSession, folder: str, target: str) -> int:
    """The living messages of an index as one segment of a new index at `target`."""
    _, rows = _rows(spark, folder)
    postings = materialise(_alive(spark, folder, rows, "postings").drop("segment"), "segments-rebuilt")
    return _commit(spark, target, 0, [_write_segment(postings, _alive(spark, folder, rows, "docs"), target)])
