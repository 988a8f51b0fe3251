"""Readers for telemetry logs, learnings, posts, annotations and dated artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.learnings import LEARNING_SCHEMA
from skein.operators.reports import POST_SCHEMA, TELEMETRY_SCHEMA

ANNOTATION_SCHEMA = (
    "phases struct<phases: array<struct<phaseId: bigint, phaseName: string, messageIndices: array<bigint>, "
    "description: string>>, taskBoundaries: array<bigint>>, "
    "annotations array<struct<messageIndex: bigint, content: string, annotation: string, color: string, reasoning: string>>"
)


def clean_telemetry(rows: DataFrame) -> DataFrame:
    """Typed telemetry without malformed, undated or nameless rows; batch or stream."""
    return (
        rows.withColumn("ts", F.try_to_timestamp("ts"))
        .filter(F.col("ts").isNotNull() & (F.col("skill_name") != ""))
    )


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return clean_telemetry(spark.read.schema(TELEMETRY_SCHEMA).json(path))


def read_learnings(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file; corrupt files are skipped."""
    rows = spark.read.schema(LEARNING_SCHEMA).option("multiLine", "true").json(path)
    return rows.filter("id is not null").withColumn("created_at", F.try_to_timestamp("created_at"))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of posts, or one post per line group."""
    rows = spark.read.schema(POST_SCHEMA).option("multiLine", "true").json(path)
    return rows.select(
        "id", F.col("conversationId").alias("conversation_id"), F.col("createdAt").alias("created"), "text",
        F.col("likeCount").alias("like_count"), F.col("retweetCount").alias("retweet_count"),
        F.col("replyCount").alias("reply_count"),
    )


def read_window_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Dated artifacts that state the window they cover."""
    rows = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name")

    def field(name: str):
        return F.try_to_timestamp(F.nullif(F.regexp_extract("value", rf"(?m)^{name}:\s*(\S+)", 1), F.lit("")))

    return rows.select(
        F.col("file_name").alias("name"), field("window_start").alias("start"), field("window_end").alias("end")
    ).filter(F.col("end").isNotNull())


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Annotation documents as the annotation table and the phase member table."""
    docs = spark.read.schema(ANNOTATION_SCHEMA).option("multiLine", "true").json(path).withColumn(
        "session_id", F.regexp_replace("_metadata.file_name", r"(-annotations)?\.json$", "")
    )
    notes = docs.select("session_id", F.inline("annotations")).withColumnRenamed("messageIndex", "msg_index")
    phases = docs.select("session_id", F.inline("phases.phases")).select(
        "session_id", F.col("phaseId").alias("phase_id"), F.col("phaseName").alias("phase_name"), "description",
        F.explode("messageIndices").alias("msg_index"),
    )
    return notes, phases
