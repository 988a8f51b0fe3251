"""Skill telemetry, token usage and post selections."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.ordered import ordinal

# Post ranking, framing text and prices per token.
REPOST_MARK = "RT @"
REPOST_WEIGHT = 2
TOP_POSTS = 15
FRAMING = (
    "Draft a blog post built from my own tweets ({label}). "
    "Find the through-line across them, keep my voice, and expand the "
    "best ideas into prose. Quote tweets where they land."
)

TELEMETRY_SCHEMA = "ts string, session_id string, project_path string, tool_name string, skill_name string, args_summary string"
POST_SCHEMA = (
    "id string, conversationId string, createdAt string, text string, likeCount bigint, retweetCount bigint, replyCount bigint"
)


# --- skills -----------------------------------------------------------------


def skills_report(events: DataFrame, since: datetime | None = None) -> DataFrame:
    """Count, last use and distinct projects per skill. `events(ts, skill_name, project_path)`."""
    kept = events.filter((F.col("skill_name") != "") & F.col("ts").isNotNull())
    if since is not None:
        kept = kept.filter(F.col("ts") >= F.lit(since))
    project = F.when(F.col("project_path") != "", X.last_segment("project_path"))
    # one row per (skill, project) first, so a popular skill is combined before it meets in one task
    pairs = kept.groupBy("skill_name", project.alias("project")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return pairs.groupBy("skill_name").agg(
        F.sum("n").alias("uses"), F.max("last").alias("last_used"), F.count("project").alias("projects")
    )


def skill_projects(events: DataFrame, since: datetime | None = None) -> DataFrame:
    """The project names behind `skills_report`, one row per skill and project."""
    kept = events.filter((F.col("skill_name") != "") & F.col("ts").isNotNull() & (F.col("project_path") != ""))
    if since is not None:
        kept = kept.filter(F.col("ts") >= F.lit(since))
    return kept.groupBy("skill_name", X.last_segment("project_path").alias("project")).agg(F.count("*").alias("uses"))


def dead_skills(known: DataFrame, events: DataFrame, since: datetime | None = None) -> DataFrame:
    """Declared skills without a use in the window. `known(skill_name)`."""
    used = skills_report(events, since).select("skill_name")
    return known.select("skill_name").distinct().join(used, "skill_name", "left_anti")


# --- usage ------------------------------------------------------------------


def usage_rollup(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost per prompt type, with one total row.

    `prices(prompt_type, input_price, output_price)`, prices per token.
    """
    # few types hold all calls: combine map-side first, price and total the few sums afterwards
    sums = usage.groupBy("prompt_type").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
    cost = F.col("prompt_tokens") * F.coalesce("input_price", F.lit(0.0)) + F.col("completion_tokens") * F.coalesce(
        "output_price", F.lit(0.0)
    )
    out = sums.join(prices, "prompt_type", "left").rollup("prompt_type").agg(
        F.grouping("prompt_type").alias("_all"), F.sum("calls").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(cost).alias("_cost"),
    )
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return out.select(
        F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("prompt_type")).alias("prompt_type"), "calls",
        "prompt_tokens", "completion_tokens", total.alias("total_tokens"),
        F.floor(total / F.col("calls") + 0.5).cast("long").alias("avg_tokens"),
        F.round("_cost", 4).alias("cost"), F.round(F.col("_cost") / F.col("calls"), 6).alias("avg_cost"),
    )


def cache_efficiency(usage: DataFrame) -> DataFrame:
    """Tokens per session and the share of input served from the cache."""
    cols = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")
    out = usage.groupBy("session_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])
    sent = F.col("input_tokens") + F.col("cache_creation_input_tokens") + F.col("cache_read_input_tokens")
    return out.withColumn(
        "cache_share", F.when(sent > 0, F.round(F.col("cache_read_input_tokens") / sent, 6)).otherwise(0.0)
    )


# --- posts ------------------------------------------------------------------
# Posts: id, conversation_id, created, text, like_count, retweet_count, reply_count


def engagement() -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero("like_count") + REPOST_WEIGHT * zero("retweet_count") + zero("reply_count")


def post_time(created: str = "created") -> Column:
    """`Thu Jan 02 03:04:05 +0000 2020` as the local time it states, null in another form."""
    parts = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (.{15}) [+-]\d{4} (\d{4})$"
    plain = F.regexp_replace(F.col(created), parts, "$1 $2")
    return F.when(F.col(created).rlike(parts), F.try_to_timestamp(plain, F.lit("MMM dd HH:mm:ss yyyy")))


def post_date(created: str = "created") -> Column:
    """ISO date, or the first characters of a text that cannot be read."""
    return F.coalesce(F.date_format(post_time(created), "yyyy-MM-dd"), F.left(created, F.lit(10)), F.lit(""))


def id_order() -> list[Column]:
    """Numeric ids in order, then the others as text."""
    number = F.expr("try_cast(id AS decimal(38, 0))")
    return [number.asc_nulls_last(), F.col("id").asc()]


def top_posts(posts: DataFrame, n: int = TOP_POSTS, since: str | None = None) -> DataFrame:
    own = posts.filter(~F.coalesce(F.col("text"), F.lit("")).startswith(REPOST_MARK))
    if since is not None:
        own = own.filter(post_time().isNotNull() & (post_date() >= since))
    scored = own.withColumn("engagement", engagement())
    return scored.orderBy(F.desc("engagement"), *id_order()).limit(n)


def thread(posts: DataFrame, conversation_id: str) -> DataFrame:
    return posts.filter(F.col("conversation_id") == conversation_id).orderBy(*id_order())


def threads(posts: DataFrame, width: int = 4096) -> DataFrame:
    """Every thread at once: 0-based place of each post in its thread, numeric ids first."""
    number = F.expr("try_cast(id AS decimal(38, 0))")
    keyed = posts.filter("conversation_id is not null").withColumn("_text_id", number.isNull()).withColumn("_num", number)
    # ids grow with time, so a slice of the id range bounds the posts one task orders
    bucket = F.struct("_text_id", F.coalesce(F.floor(F.col("_num") / width), F.lit(0)).alias("slice"), F.when(F.col("_text_id"), F.left("id", F.lit(2))).otherwise("").alias("head"))
    return ordinal(keyed, ["conversation_id"], ["_text_id", "_num", "id"], bucket, "pos").drop("_text_id", "_num")


def posts_to_messages(posts: DataFrame, order: list[str], bucket: Column, label: str) -> DataFrame:
    """Posts as user messages behind a framing message 0.

    `order` is a total order of the chosen posts and `bucket` cuts it, so a
    large selection is numbered in parallel.
    """
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    text = F.concat(
        F.lit("["), post_date(), F.lit("] ("), n("like_count"), F.lit("♥ "), n("retweet_count"), F.lit("🔁 "),
        n("reply_count"), F.lit("💬) "), X.strip(F.coalesce("text", F.lit(""))),
    )
    keyed = posts.withColumn("_all", F.lit(1))
    placed = ordinal(keyed, ["_all"], order, bucket, "_no")
    said = placed.select((F.col("_no") + 1).alias("msg_index"), F.lit("user").alias("role"), text.alias("text"))
    # the framing row is a whole-table aggregate of the chosen posts, so it exists even for none
    framing = posts.agg(F.count("*").alias("_n")).select(
        F.lit(0).cast("long").alias("msg_index"), F.lit("user").alias("role"), F.lit(FRAMING.format(label=label)).alias("text")
    )
    return framing.unionByName(said)
