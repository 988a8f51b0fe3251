"""Learning records: search, feedback, review state."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Search points, recency, feedback step and floor.
WORD, PHRASE, TAG, LANGUAGE, RECENT = 1, 3, 2, 1, 1
RECENT_DAYS = 7
STEP, FLOOR, START = 0.1, 0.3, 1.0

LEARNING_SCHEMA = (
    "id string, version int, problem string, root_cause string, solution string, what_didnt_work array<string>, "
    "trigger_conditions string, tags array<string>, type string, source_session string, source_date string, "
    "files_touched array<string>, languages array<string>, author string, importance double, times_retrieved int, "
    "times_useful int, created_at string, updated_at string, share_status string, reviewed_at string, "
    "redaction_summary struct<count: int, types: array<string>>"
)


def recent(learnings: DataFrame, limit: int = 10) -> DataFrame:
    return learnings.orderBy(F.desc("created_at"), "id").limit(limit)


def by_id(learnings: DataFrame, wanted: str) -> DataFrame:
    return learnings.filter(F.col("id") == wanted)


def by_ids(learnings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Many lookups at once. `wanted(id, ...)`."""
    return learnings.join(wanted.select("id").distinct(), "id", "left_semi")


def retrieval_log(ids: DataFrame, at: datetime) -> DataFrame:
    """Log rows for retrieved learnings, counted later by `counters`."""
    return ids.select("id", F.lit(at).alias("ts"), F.lit("retrieved").alias("kind"))


def search(
    learnings: DataFrame,
    query: str,
    now: datetime,
    tags: Sequence[str] = (),
    language: str | None = None,
    limit: int = 5,
) -> DataFrame:
    """Scored learnings; recency alone is not enough to be found."""
    q = query.lower()
    words = q.split()
    if not words:
        raise ValueError("a search needs a word")
    text = F.lower(F.concat_ws(" ", "problem", "root_cause", "solution", "trigger_conditions"))
    wanted = F.array(*[F.lit(w) for w in words])
    points = F.size(F.filter(wanted, lambda w: F.contains(F.col("_text"), w))) * WORD
    points = points + F.when(F.contains("_text", F.lit(q)), PHRASE).otherwise(0)
    if tags:
        asked = F.array(*[F.lit(t.lower()) for t in tags])
        points = points + F.size(F.filter(asked, lambda t: F.array_contains("tags", t))) * TAG
    if language:
        points = points + F.when(F.array_contains("languages", language.lower()), LANGUAGE).otherwise(0)
    young = F.col("created_at") > F.lit(now) - F.expr(f"interval {RECENT_DAYS} days")
    points = points + F.when(young, RECENT).otherwise(0)
    scored = learnings.withColumn("_text", text).withColumn("_points", points)
    scored = scored.withColumn("score", F.round(F.col("_points") * F.col("importance"), 6))
    return (
        scored.filter(F.col("_points") > 1)
        .drop("_text", "_points")
        .orderBy(F.desc("score"), F.desc("created_at"), "id")
        .limit(limit)
    )


def counters(log: DataFrame) -> DataFrame:
    """Retrievals and useful votes per learning. `log(id, ts, kind)`."""
    return log.groupBy("id").agg(
        F.count_if(F.col("kind") == "retrieved").alias("times_retrieved"),
        F.count_if(F.col("kind") == "useful").alias("times_useful"),
    )


def importance(
    feedback: DataFrame, bucket: Column, order: Sequence[str], learnings: DataFrame | None = None
) -> DataFrame:
    """Importance after an ordered feedback log, floored at every step.

    It starts at the learning's own importance, or at 1 where `learnings(id,
    importance)` has none.

    `feedback(id, useful, ...)`. One step maps x to max(floor, x + d). Steps
    compose to the same form, so the result is the larger of `start + sum of d`
    and, over all steps, `floor + sum of the later d`. `bucket` cuts the log of
    one learning along `order`; inside a bucket a running sum gives the second
    term, and one row per bucket is carried across. Tenths keep the sums exact.
    """
    d = F.when(F.col("useful"), 1).otherwise(-1)
    rows = feedback.withColumn("_b", bucket).withColumn("_d", d)
    later = (
        Window.partitionBy("id", "_b")
        .orderBy(*[F.desc(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    floor, start = round(FLOOR / STEP), round(START / STEP)
    steps = rows.withColumn("_after", F.coalesce(F.sum("_d").over(later), F.lit(0)))
    parts = steps.groupBy("id", "_b").agg(
        F.sum("_d").alias("_sum"), F.max(F.lit(floor) + F.col("_after")).alias("_low"), F.count("*").alias("_n")
    )
    after = Window.partitionBy("id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    tail = F.coalesce(F.sum("_sum").over(after), F.lit(0))
    whole = parts.withColumn("_low", F.col("_low") + tail).groupBy("id").agg(
        F.sum("_sum").alias("_sum"), F.max("_low").alias("_low"), F.sum("_n").alias("votes")
    )
    begin = F.lit(start)
    if learnings is not None:
        own = learnings.groupBy("id").agg(F.max("importance").alias("_own"))
        whole = whole.join(own, "id", "left")
        begin = F.coalesce(F.round(F.col("_own") / STEP), begin)
    return whole.select(
        "id", "votes", F.round(F.greatest(F.col("_sum") + begin, F.col("_low")) * STEP, 6).alias("importance")
    )


def review_status(decisions: DataFrame) -> DataFrame:
    """Share status after an ordered decision log.

    `decisions(id, at, action)` with actions share, private, edit-tags, delete
    and skip; `at` is a total order. The last share or private decides; an edit
    after a share returns to local; a delete removes the learning for good.
    Only maxima are needed, so the log of one learning combines map-side.
    """
    a = F.col("action")
    verdict = a.isin("share", "private")
    folded = decisions.groupBy("id").agg(
        F.max(a == "delete").alias("_gone"),
        F.max(F.when(verdict, F.struct("at", "action"))).alias("_last"),
        F.max(F.when(a == "edit-tags", F.col("at"))).alias("_edit"),
    )
    edited = F.coalesce(F.col("_edit") > F.col("_last.at"), F.lit(False))
    status = (
        F.when(F.col("_last").isNull(), "local")
        .when(F.col("_last.action") == "private", "private")
        .when(edited, "local")
        .otherwise("reviewed")
    )
    return folded.filter(~F.col("_gone")).select(
        "id", status.alias("share_status"), F.when(status != "local", F.col("_last.at")).alias("reviewed_at")
    )


def review_queue(learnings: DataFrame, show_all: bool = False) -> DataFrame:
    return learnings if show_all else learnings.filter(F.coalesce("share_status", F.lit("local")) == "local")


def shareable(learnings: DataFrame) -> DataFrame:
    """Only reviewed learnings may leave."""
    return learnings.filter("share_status = 'reviewed'")


def pending_review(pending: DataFrame, new: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Ids still to review: earlier and new ones, each once, without the reviewed."""
    return pending.select("id").union(new.select("id")).distinct().join(reviewed.select("id"), "id", "left_anti")
