"""Micro-batch ingest, running session state and live skill counts.

Growing trees arrive through `tail_stream`, line by line. A line log, JSON files
of `session_id, project, source, file_path, line_no, line` rows, each line once,
and closed transcript files can be streamed as they are.

What a batch has to know of earlier ones is one state row per session. Every
`compact_every` batches the state is written as a whole; until then it is
the last written state plus the partial roll-ups of the few batches since. A batch
thus reads as much after a year as after an hour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators import sessions as S
from skein.operators.ordered import CHUNK
from skein.operators.reports import TELEMETRY_SCHEMA
from skein.session import materialise
from skein.sources import sinks, transcripts
from skein.sources.logs import clean_telemetry
from skein.sources.tail import TranscriptTail

LINE_LOG = "session_id string, project string, source string, file_path string, line_no bigint, line string"
#: bytes of a file whose messages one task numbers, where `line_no` counts bytes
TAIL_CHUNK = 1 << 18
#: batches between two written states, and states that are kept
COMPACT_EVERY, KEEP_STATES = 16, 3

#: finds the private sessions of a batch: messages, working directories -> session_id
PrivacyRule = Callable[[DataFrame, DataFrame], DataFrame]


def line_log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(LINE_LOG).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def tail_stream(spark: SparkSession, claude_root: str | None = None, codex_root: str | None = None, **options) -> DataFrame:
    """Lines of files that grow, as they are appended; give `start_ingest` the chunk `TAIL_CHUNK`."""
    spark.dataSource.register(TranscriptTail)
    roots = {k: v for k, v in (("claude_root", claude_root), ("codex_root", codex_root)) if v}
    return spark.readStream.format(TranscriptTail.name()).options(**roots, **options).load()


# --- state ------------------------------------------------------------------


def _last_state(spark: SparkSession, folder: str, before: int) -> int:
    """The newest written state below `before`, -1 without one."""
    if not sinks.path_exists(spark, f"{folder}/_states"):
        return -1
    written = spark.read.parquet(f"{folder}/_states").filter(F.col("upto") < before)
    return written.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]


def _state_parts(spark: SparkSession, folder: str, before: int | None) -> list[DataFrame]:
    """The last written state and the partial roll-ups since, in one form."""
    before = sinks.last_commit(spark, folder) + 1 if before is None else before
    at, parts = _last_state(spark, folder, before), []
    if at >= 0:
        parts.append(spark.read.parquet(f"{folder}/state/upto={at}").withColumn("batch", F.lit(at).cast("int")))
    since = sinks.committed_between(spark, folder, "partials", at, before)
    if since is not None:
        parts.append(since.withColumn("since", F.when(F.col("restarted"), F.col("batch")).otherwise(0).cast("int")).drop("restarted"))
    return parts


def state_inputs(spark: SparkSession, folder: str) -> list[str]:
    """Files that `running_state` reads."""
    return [f for part in _state_parts(spark, folder, None) for f in part.inputFiles()]


def running_state(spark: SparkSession, folder: str, before: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
    """Merged roll-up of each session after the batches below `before`, and `since`, the batch it last began in.

    A session whose file was replaced begins anew: what earlier batches said of it is left out.
    """
    parts = _state_parts(spark, folder, before)
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if only is not None:
        rows = rows.join(only, "session_id", "left_semi")
    begun = rows.filter("since > 0").groupBy("session_id").agg(F.max("since").alias("_since"))
    rows = rows.join(begun, "session_id", "left").filter("_since IS NULL OR batch >= _since")
    since = rows.groupBy("session_id").agg(F.max("since").alias("since"))
    return S.merge_rollups(rows).join(since, "session_id")


def write_state(spark: SparkSession, folder: str, upto: int) -> None:
    """Write the state after batch `upto` and forget all but the last few."""
    state = running_state(spark, folder, upto + 1)
    state.write.mode("overwrite").parquet(f"{folder}/state/upto={upto}")
    spark.range(1).select(F.lit(upto).alias("done")).write.mode("overwrite").parquet(f"{folder}/_states/upto={upto}")
    old = spark.read.parquet(f"{folder}/_states").select("upto").orderBy(F.desc("upto")).offset(KEEP_STATES).collect()
    for row in old:
        for kind in ("_states", "state"):  # the marker goes first
            sinks.remove_path(spark, f"{folder}/{kind}/upto={row['upto']}")


def ingest_batch(
    lines: DataFrame,
    batch_id: int,
    folder: str,
    private: PrivacyRule | None = None,
    chunk: int = CHUNK,
    compact_every: int = COMPACT_EVERY,
) -> None:
    """Parse one batch behind everything committed before it, and commit its tables.

    Running the same batch again looks only at earlier batches and replaces its
    own output, so a restart neither loses nor repeats messages. A row without a
    line says that its file begins anew.
    """
    spark = lines.sparkSession
    # messages, directories and session ids all read the batch
    lines = lines.persist(StorageLevel.DISK_ONLY)
    try:
        anew = lines.filter("line IS NULL").groupBy("session_id").agg(F.max("source").alias("_anew"))
        said = lines.filter("line IS NOT NULL")
        messages = transcripts.parse_messages(said, chunk=chunk)
        known = running_state(spark, folder, batch_id, lines.select("session_id").distinct())
        if known is not None:
            messages = S.continue_numbering(messages, known.join(anew, "session_id", "left_anti"))
        # four tables come out of the parsed batch, so it is parsed once
        stored = materialise(messages, "batch")
        gone = stored.select("session_id").limit(0)
        dirs = transcripts.working_dirs(said)
        if private:
            gone = private(stored, dirs)
        partials = S.partial_rollup(stored, dirs).join(anew, "session_id", "full_outer")
        sinks.commit_batch(
            {
                "messages": stored,
                "partials": partials.withColumns(
                    {
                        "source": F.coalesce("source", "_anew"),
                        "msg_count": F.coalesce("msg_count", F.lit(0)),
                        "restarted": F.col("_anew").isNotNull(),
                    }
                ).drop("_anew"),
                "session_files": S.session_files(S.explode_files(stored)),
                "private": gone,
            },
            folder,
            batch_id,
        )
    finally:
        lines.unpersist()
    if (batch_id + 1) % compact_every == 0:
        write_state(spark, folder, batch_id)


def start_ingest(
    lines: DataFrame,
    folder: str,
    checkpoint: str,
    private: PrivacyRule | None = None,
    every: str | None = None,
    chunk: int = CHUNK,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Run `ingest_batch` per micro-batch; `every` merges bursts, None drains and stops."""
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: ingest_batch(df, batch_id, folder, private, chunk, compact_every)
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _held_back(spark: SparkSession, folder: str, state: DataFrame, strict_source: str) -> DataFrame:
    """Sessions that are private in any batch, or whose scope no batch has told yet."""
    private = sinks.read_committed(spark, folder, "private").select("session_id")
    return private.union(S.unplaced_sessions(state, strict_source)).distinct()


def _readable(spark: SparkSession, folder: str, table: str, strict_source: str) -> DataFrame:
    """Committed rows of sessions in scope, without what a replaced file had said."""
    state = running_state(spark, folder)
    begun = state.filter("since > 0").select("session_id", "since")
    rows = sinks.read_committed(spark, folder, table).join(begun, "session_id", "left")
    rows = rows.filter("since IS NULL OR batch >= since").drop("batch", "since")
    return S.without_sessions(rows, _held_back(spark, folder, state, strict_source))


def read_messages(spark: SparkSession, folder: str, strict_source: str = transcripts.CODEX) -> DataFrame:
    """Committed messages of sessions in scope.

    A session of `strict_source` becomes readable with the first batch that
    states its working directory.
    """
    return _readable(spark, folder, "messages", strict_source)


def read_sessions(spark: SparkSession, folder: str, strict_source: str = transcripts.CODEX) -> DataFrame:
    state = running_state(spark, folder)
    return S.without_sessions(S.finish_rollup(state), _held_back(spark, folder, state, strict_source))


def read_session_files(spark: SparkSession, folder: str, strict_source: str = transcripts.CODEX) -> DataFrame:
    return _readable(spark, folder, "session_files", strict_source).distinct()


def running_sessions(messages: DataFrame) -> DataFrame:
    """Session roll-up of a message stream, for update or complete output."""
    return S.finish_rollup(S.partial_rollup(messages))


def skill_stream(spark: SparkSession, folder: str) -> DataFrame:
    return clean_telemetry(spark.readStream.schema(TELEMETRY_SCHEMA).json(folder))


def skill_counts(events: DataFrame, window: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Live uses per skill; with `window`, per event-time window behind a watermark."""
    if window is None:
        return events.groupBy("skill_name").agg(F.count("*").alias("uses"), F.max("ts").alias("last_used"))
    timed = events.withWatermark("ts", lateness)
    return (
        timed.groupBy(F.window("ts", window).alias("w"), "skill_name")
        .agg(F.count("*").alias("uses"))
        .select(F.col("w.start").alias("window_start"), "skill_name", "uses")
    )
