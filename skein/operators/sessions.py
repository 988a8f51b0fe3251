"""Session roll-ups, listings and scope rules over `messages`."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.content import render_calls

# Fixed value: kept length of the first prompt.
FIRST_PROMPT = 500


def _first_prompt() -> Column:
    prompt = F.col("is_human_prompt")
    return F.min_by(
        F.when(prompt, F.left("user_text", F.lit(FIRST_PROMPT))), F.when(prompt, F.col("msg_index"))
    )


def _first(col: str) -> Column:
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.col("msg_index")))


def session_rollup(messages: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """One row per session. Every aggregate combines map-side, so long sessions do not skew.

    `dirs(session_id, line_no, cwd)` has the working directories of all lines,
    retained or not; the first one of a session is its directory. Without it
    the retained messages' own are used.
    """
    if dirs is not None:
        return finish_rollup(partial_rollup(messages, dirs))
    return messages.groupBy("session_id").agg(
        _first("project").alias("project"),
        _first("cwd").alias("cwd"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_msg_at"),
        F.count("*").alias("msg_count"),
        _first_prompt().alias("first_user_prompt"),
        F.max("source").alias("source"),
    )


def partial_rollup(messages: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """Roll-up of one batch in a form `merge_rollups` can combine in any order.

    With `dirs(session_id, source, line_no, cwd)`, a session that only states a
    directory in this batch has a row as well, with no messages.
    """
    prompt, dir_ = F.col("is_human_prompt"), F.col("cwd").isNotNull()
    if dirs is not None:
        told = dirs.groupBy("session_id").agg(
            F.max("source").alias("_source"), F.min(F.struct(F.col("line_no").alias("at"), "cwd")).alias("_cwd")
        )
        own = partial_rollup(messages).drop("first_cwd").join(told, "session_id", "full_outer")
        return own.select(
            "session_id", F.coalesce("source", "_source").alias("source"), "project", "started_at", "last_msg_at",
            F.coalesce("msg_count", F.lit(0)).alias("msg_count"), F.col("_cwd").alias("first_cwd"), "first_prompt",
        )
    return messages.groupBy("session_id").agg(
        F.max("source").alias("source"),
        F.max("project").alias("project"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_msg_at"),
        F.count("*").alias("msg_count"),
        F.min(F.when(dir_, F.struct(F.col("msg_index").cast("long").alias("at"), "cwd"))).alias("first_cwd"),
        F.min(
            F.when(prompt, F.struct("msg_index", F.left("user_text", F.lit(FIRST_PROMPT)).alias("prompt")))
        ).alias("first_prompt"),
    )


def merge_rollups(partials: DataFrame) -> DataFrame:
    """Combine partial roll-ups; the order of batches does not matter."""
    merged = partials.groupBy("session_id").agg(
        F.max("source").alias("source"),
        F.max("project").alias("project"),
        F.min("started_at").alias("started_at"),
        F.max("last_msg_at").alias("last_msg_at"),
        F.sum("msg_count").alias("msg_count"),
        F.min("first_cwd").alias("first_cwd"),
        F.min("first_prompt").alias("first_prompt"),
    )
    return merged


def finish_rollup(merged: DataFrame) -> DataFrame:
    return merged.filter("msg_count > 0").select(
        "session_id", "project", F.col("first_cwd.cwd").alias("cwd"), "started_at", "last_msg_at",
        "msg_count", F.col("first_prompt.prompt").alias("first_user_prompt"), "source",
    )


def session_files(calls: DataFrame) -> DataFrame:
    """Distinct (session, file) pairs."""
    return calls.select("session_id", "file_path").filter("file_path <> ''").distinct()


def explode_files(messages: DataFrame) -> DataFrame:
    return messages.select("session_id", "msg_index", F.explode("file_paths").alias("file_path"))


def explode_calls(messages: DataFrame) -> DataFrame:
    """One row per tool call of a message."""
    return messages.select(
        "session_id", "msg_index", F.posexplode("tool_calls").alias("call_pos", "call")
    ).select("session_id", "msg_index", "call_pos", F.col("call.name").alias("tool"), F.col("call.preview").alias("preview"))


def recent_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(F.col("last_msg_at").desc_nulls_last(), "session_id").limit(limit)


def sessions_by_file(
    sessions: DataFrame, files: DataFrame, path: str, limit: int = 20
) -> DataFrame:
    """Newest sessions that touched a path or a path containing it, one row each."""
    hits = files.filter(F.lower("file_path").contains(path.lower())).select("session_id").distinct()
    return (
        sessions.join(hits, "session_id", "left_semi")
        .orderBy(F.col("last_msg_at").desc_nulls_last(), "session_id")
        .limit(limit)
    )


def project_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project").agg(F.count("*").alias("session_count"))


def private_sessions(
    messages: DataFrame,
    dirs: DataFrame,
    text_patterns: Sequence[str] = (),
    dir_patterns: Sequence[str] = (),
    project_patterns: Sequence[str] = (),
) -> DataFrame:
    """Sessions whose conversation, working directory or project is out of scope.

    Tool output and system text are not part of `messages`, so they are not
    inspected. There is no default pattern.
    """

    def hit(col: Column, patterns: Sequence[str]) -> Column:
        return X.any_of(col, list(patterns)) if patterns else F.lit(False)

    said = F.concat_ws("\n", "user_text", "assistant_text")
    by_message = messages.filter(hit(said, text_patterns) | hit(F.col("project"), project_patterns))
    by_dir = dirs.filter(hit(F.col("cwd"), dir_patterns))
    return by_message.select("session_id").union(by_dir.select("session_id")).distinct()


def without_sessions(table: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop everything derived from the excluded sessions."""
    return table.join(excluded, "session_id", "left_anti")


def known_scope(messages: DataFrame, dirs: DataFrame, strict_source: str) -> DataFrame:
    """Drop sessions of `strict_source` that state no working directory anywhere."""
    placed = dirs.select("session_id").distinct()
    strict = messages.filter(F.col("source") == strict_source).join(placed, "session_id", "left_semi")
    return messages.filter(F.col("source") != strict_source).unionByName(strict)


def window_sessions(
    sessions: DataFrame,
    since: datetime,
    until: datetime,
    project: str | None = None,
    min_messages: int = 3,
    limit: int | None = 25,
) -> DataFrame:
    """Sessions last active in a window, newest first."""
    out = sessions.filter(
        F.col("last_msg_at").between(F.lit(since), F.lit(until)) & (F.col("msg_count") >= min_messages)
    )
    if project is not None:
        out = out.filter(F.lower("project").contains(project.lower()))
    out = out.orderBy(F.desc("last_msg_at"), "session_id")
    return out if limit is None else out.limit(limit)


def window_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count("*").alias("total_sessions"),
        F.coalesce(F.sum("msg_count"), F.lit(0)).cast("long").alias("total_messages"),
    )


def searchable(messages: DataFrame) -> DataFrame:
    """Messages with the four searched fields as text."""
    return messages.withColumn("tool_calls", render_calls(F.col("tool_calls"))).withColumn(
        "file_paths", F.array_join("file_paths", "\n")
    )


# --- batch increments -------------------------------------------------------


def new_lines(lines: DataFrame, cursor: DataFrame) -> DataFrame:
    """Lines beyond `cursor(file_path, lines_seen)`."""
    seen = cursor.select("file_path", "lines_seen")
    joined = lines.join(seen, "file_path", "left")
    return joined.filter(F.col("line_no") >= F.coalesce("lines_seen", F.lit(0))).drop("lines_seen")


def continue_numbering(batch: DataFrame, sessions: DataFrame) -> DataFrame:
    """Shift a batch numbered from 0 behind the messages its sessions already have."""
    counts = sessions.select("session_id", F.col("msg_count").alias("_have"))
    return (
        batch.join(counts, "session_id", "left")
        .withColumn("msg_index", F.col("msg_index") + F.coalesce("_have", F.lit(0)))
        .drop("_have")
    )


def unplaced_sessions(merged: DataFrame, strict_source: str) -> DataFrame:
    """Sessions of `strict_source` that no line has given a working directory yet."""
    return merged.filter((F.col("source") == strict_source) & F.col("first_cwd").isNull()).select("session_id")


def replaced_files(files: DataFrame, cursor: DataFrame) -> DataFrame:
    """Files now smaller than what was read of them, emptied ones too: their sessions must be rebuilt.

    `files(file_path, session_id, file_size)` is a listing; a line table has the columns
    too, but no row of an empty file.
    """
    now = files.groupBy("file_path", "session_id").agg(F.max("file_size").alias("size"))
    before = cursor.select("file_path", F.col("size").alias("_size"))
    return now.join(before, "file_path").filter("size < _size").select("file_path", "session_id")
