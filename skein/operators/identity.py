"""Tags that name one session each, and what a citation's tag names.

Eight characters of an id tell sessions apart only as long as there are few.
Here a session's tag is its shortest prefix, of at least eight characters, that no other
id has: one character more than it shares with its neighbours in order of ids.
An id that is itself the start of another one is its own tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import materialise

# Fixed value: characters of a tag.
TAG = 8


def common_prefix(a: Column, b: Column) -> Column:
    """Number of characters that two texts start with alike; 0 where one is null."""
    places = F.sequence(F.lit(0), F.coalesce(F.least(F.length(a), F.length(b)), F.lit(0)))
    return F.size(F.filter(places, lambda i: (i > 0) & (F.left(a, i) == F.left(b, i))))


def session_tags(sessions: DataFrame, least: int = TAG) -> DataFrame:
    """session_id, tag of every distinct id.

    Ids are range-partitioned, so each meets its neighbours in its own partition; the
    outermost ones of a partition meet the edges of the partitions beside it, one row each.
    """
    ids = materialise(sessions.filter("session_id IS NOT NULL").select("session_id").distinct(), "tag-ids")
    ids = ids.repartitionByRange("session_id").sortWithinPartitions("session_id")
    ids = materialise(ids.select("session_id", F.spark_partition_id().alias("part")), "tag-order")
    edges = ids.groupBy("part").agg(F.min("session_id").alias("lo"), F.max("session_id").alias("hi"))
    along = Window.orderBy("part")  # one row per partition
    edges = edges.select("part", F.lag("hi").over(along).alias("before"), F.lead("lo").over(along).alias("after"))
    here = Window.partitionBy("part").orderBy("session_id")
    near = ids.select("*", F.lag("session_id").over(here).alias("prev"), F.lead("session_id").over(here).alias("next")).join(edges, "part")
    shared = F.greatest(
        common_prefix(F.col("session_id"), F.coalesce("prev", "before")), common_prefix(F.col("session_id"), F.coalesce("next", "after"))
    )
    return near.select("session_id", F.left("session_id", F.greatest(F.lit(least), shared + 1)).alias("tag"))


def resolve(cited: DataFrame, sessions: DataFrame) -> DataFrame:
    """`cited` (with `tag`) plus `session_id` and `status`: unique, ambiguous or unknown.

    A tag names the one session whose id starts with it, or the session whose id it is.
    Only prefixes of lengths that tags have are formed, and counted before they are joined.
    """
    lengths = cited.agg(F.collect_set(F.length("tag")).alias("lengths")).select("lengths").scalar()
    ids = sessions.filter("session_id IS NOT NULL").select("session_id").distinct()
    starts = ids.select("session_id", F.explode(lengths).alias("n")).filter("n > 0 AND n <= length(session_id)")
    starts = starts.groupBy(F.left("session_id", F.col("n")).alias("_tag")).agg(
        F.count("*").alias("_found"), F.min("session_id").alias("_first"), F.max(F.col("session_id") == F.left("session_id", F.col("n"))).alias("_whole")
    )
    one = F.col("_whole") | (F.col("_found") == 1)
    # of the ids that start with a tag, the tag itself is the smallest
    return cited.join(starts, F.col("tag") == F.col("_tag"), "left").select(
        *cited.columns, F.when(one, F.col("_first")).alias("session_id"),
        F.when(F.col("_found").isNull(), "unknown").when(one, "unique").otherwise("ambiguous").alias("status"),
    )


def tagged(citations: DataFrame) -> DataFrame:
    """Citations `session:message` with the session's part as `tag`."""
    return citations.withColumn("tag", F.substring_index("citation", ":", 1)).filter("tag <> ''")


def support(citations: DataFrame, sessions: DataFrame) -> DataFrame:
    """proposal_id, sessions (distinct ones cited without doubt), ambiguous and unknown tags.

    Two tags of one session count once, and a tag that several sessions share counts for none.
    """
    found = resolve(tagged(citations), sessions)

    def distinct(status: str, column: str) -> Column:
        return F.count_distinct(F.when(F.col("status") == status, F.col(column)))

    return found.groupBy("proposal_id").agg(
        distinct("unique", "session_id").alias("sessions"), distinct("ambiguous", "tag").alias("ambiguous"), distinct("unknown", "tag").alias("unknown")
    )
