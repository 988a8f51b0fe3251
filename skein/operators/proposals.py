"""Checks of mined proposals against the sessions they cite.

Proposals: `proposal_id, kind, title, body, category`, where `title` is the slug,
rule or name and `body` the drafted text or fix. Citations: `proposal_id, citation`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.ordered import ordinal

# Evidence needed, allowed categories and reasons by kind.
MIN_SESSIONS = 2
CATEGORIES = {
    "memory": ["feedback", "user", "project", "reference"],
    "anti_pattern": ["rediscovery", "manual-toil", "wrong-tool"],
}
MISSING = {
    "skill": "missing slug or draft_skill_md",
    "memory": "missing slug/body/type",
    "rule": "missing rule or markdown",
    "anti_pattern": "missing name or fix",
}
CATEGORY_WORD = {"memory": "invalid type: ", "anti_pattern": "invalid class: "}


def support(citations: DataFrame) -> DataFrame:
    """Distinct cited sessions per proposal; a citation is `session:message`."""
    sid = F.substring_index("citation", ":", 1)
    return (
        citations.select("proposal_id", sid.alias("sid"))
        .filter("sid <> ''")
        .groupBy("proposal_id")
        .agg(F.count_distinct("sid").alias("sessions"))
    )


def validate(proposals: DataFrame, citations: DataFrame, min_sessions: int = MIN_SESSIONS) -> DataFrame:
    """Status and first failing reason: evidence, then required fields, then category."""
    j = proposals.join(support(citations), "proposal_id", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))
    kind, n = F.col("kind"), F.col("sessions").cast("string")
    few = F.concat(
        F.lit("only "), n, F.lit(" distinct session(s)"),
        F.when(kind.isin("skill", "memory"), f", need ≥{min_sessions}").otherwise(""),
    )
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    incomplete = empty("title") | empty("body") | ((kind == "memory") & empty("category"))
    missing = F.create_map(*[F.lit(x) for kv in MISSING.items() for x in kv])
    bad = F.lit(None).cast("string")
    for name, allowed in CATEGORIES.items():
        wrong = (kind == name) & ~F.coalesce(F.col("category").isin(allowed), F.lit(False))
        bad = F.when(wrong, F.concat(F.lit(CATEGORY_WORD[name]), F.coalesce("category", F.lit("undefined")))).otherwise(bad)
    reason = F.when(F.col("sessions") < min_sessions, few).when(incomplete, F.element_at(missing, kind)).otherwise(bad)
    return j.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "accepted").otherwise("dropped")
    )


def outcomes(validated: DataFrame) -> DataFrame:
    return validated.groupBy("kind", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count("*").alias("proposals")
    )


def proposal_files(validated: DataFrame, date: str) -> DataFrame:
    """File name and body of each accepted proposal.

    Rules are numbered from 1 in id order. The accepted list of one run is
    numbered through the bucketed ordinal like any other sequence.
    """
    ok = validated.filter("status = 'accepted'")
    numbered = ordinal(
        ok, ["kind"], ["proposal_id"], F.left("proposal_id", F.lit(4)), "_no"
    )
    no = (F.col("_no") + 1).cast("string")
    padded = F.when(F.length(no) >= 2, no).otherwise(F.lpad(no, 2, "0"))
    rule = F.coalesce(F.nullif(X.slug_runs("title"), F.lit("")), F.lit("rule"))
    stem = (
        F.when(F.col("kind") == "memory", X.slug_underscores("title"))
        .when(F.col("kind") == "rule", F.concat(padded, F.lit("-"), rule))
        .otherwise(X.slug_dashes("title"))
    )
    return numbered.select(
        "proposal_id", "kind", F.concat(F.lit(date + "-"), stem, F.lit(".md")).alias("file_name"),
        F.concat(X.strip("body"), F.lit("\n")).alias("body"),
    )
