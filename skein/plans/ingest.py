"""Queries on reading, session tables and scope."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import content as C
from skein.functions import text as X
from skein.operators import sessions as S
from skein.operators.ordered import chunk_of, ordinal
from skein.plans.adapters import Tables, stamp
from skein.plans.registry import query
from skein.session import shared_folder
from skein.sources import transcripts as R
from skein.sources.generations import Store

DAY1, DAY4 = datetime(2024, 1, 2), datetime(2024, 1, 5)

ROLLUP_SQL = """
SELECT session_id, project, cwd, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_msg_at, count(*) AS msg_count,
  coalesce(arg_min(left(user_text, 500), msg_index) FILTER (WHERE is_human_prompt), '') AS first_user_prompt, source
FROM a_msg GROUP BY session_id, project, cwd, source"""

SESSIONS_SQL = """
SELECT session_id, project, source, min(ts) AS started_at, max(ts) AS last_msg_at, count(*) AS msg_count,
  coalesce(arg_min(left(user_text, 500), msg_index) FILTER (WHERE is_human_prompt), '') AS first_user_prompt
FROM a_msg GROUP BY session_id, project, source"""


def _flat(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_id", "project", "cwd", stamp("started_at").alias("started_at"),
        stamp("last_msg_at").alias("last_msg_at"), "msg_count",
        F.coalesce("first_user_prompt", F.lit("")).alias("first_user_prompt"), "source",
    )


@query("session_rollup", ROLLUP_SQL)
def session_rollup(t: Tables) -> DataFrame:
    return _flat(S.session_rollup(t.a_msg))


@query("rollup_merge", ROLLUP_SQL)
def rollup_merge(t: Tables) -> DataFrame:
    early, late = t.a_msg.filter("turn < 4"), t.a_msg.filter("turn >= 4")
    partials = S.partial_rollup(early).unionByName(S.partial_rollup(late))
    return _flat(S.finish_rollup(S.merge_rollups(partials)))


@query(
    "source_union",
    """SELECT source, project, count(*) AS messages FROM a_msg GROUP BY source, project""",
)
def source_union(t: Tables) -> DataFrame:
    lines = _packed_claude(t).unionByName(_packed_codex(t))
    return R.parse_messages(lines).groupBy("source", "project").agg(F.count("*").alias("messages"))


def _line_columns(t: Tables, source: str) -> DataFrame:
    return t.turns.filter(F.col("source") == source).withColumn("line_no", F.col("turn")).withColumn(
        "iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    )


def _packed_claude(t: Tables) -> DataFrame:
    """Conversation rows written as vendor-1 lines: even turns plain, odd turns as blocks."""
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    plain = F.to_json(F.struct(F.col("role"), F.col("text").alias("content")))
    blocks = F.to_json(F.struct(F.col("role"), block.alias("content")))
    head = F.to_json(F.struct(F.col("role").alias("type"), F.col("iso").alias("timestamp"), "cwd"))
    message = F.when(F.col("turn") % 2 == 0, plain).otherwise(blocks)
    line = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"message":'), message, F.lit("}"))
    return _line_columns(t, R.CLAUDE).withColumn("head", head).select(
        "session_id", "project", "source", "line_no", line.alias("line")
    )


def _packed_codex(t: Tables) -> DataFrame:
    kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text")
    block = F.array(F.struct(kind.alias("type"), F.col("text").alias("text")))
    payload = F.struct(F.lit("message").alias("type"), "role", block.alias("content"))
    line = F.to_json(
        F.struct(F.lit("response_item").alias("type"), F.col("iso").alias("timestamp"), "cwd", payload.alias("payload"))
    )
    return _line_columns(t, R.CODEX).select("session_id", "project", "source", "line_no", line.alias("line"))


_PARSED = "SELECT session_id, msg_index, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, cwd, user_text, assistant_text, is_human_prompt FROM a_msg WHERE source = '{}'"


def _parsed(messages: DataFrame) -> DataFrame:
    return messages.select(
        "session_id", "msg_index", stamp("ts").alias("ts"), "cwd", "user_text", "assistant_text", "is_human_prompt"
    )


@query("parse_messages", _PARSED.format("claude-code"))
def parse_messages(t: Tables) -> DataFrame:
    return _parsed(R.parse_messages(_packed_claude(t), [R.CLAUDE]))


@query("parse_rollout", _PARSED.format("codex"))
def parse_rollout(t: Tables) -> DataFrame:
    return _parsed(R.parse_messages(_packed_codex(t), [R.CODEX]))


@query(
    "incremental_append",
    "SELECT session_id, msg_index, text FROM a_msg",
)
def incremental_append(t: Tables) -> DataFrame:
    lines = _packed_claude(t).unionByName(_packed_codex(t)).withColumn("file_path", F.col("session_id"))
    first = R.parse_messages(lines.filter("line_no < 3"))
    cursor = lines.filter("line_no < 3").groupBy("file_path").agg((F.max("line_no") + 1).alias("lines_seen"))
    have = S.finish_rollup(S.merge_rollups(S.partial_rollup(first)))
    fresh = S.continue_numbering(R.parse_messages(S.new_lines(lines, cursor)), have)
    return first.unionByName(fresh).select(
        "session_id", "msg_index", F.concat("user_text", "assistant_text").alias("text")
    )


@query(
    "session_discovery",
    """SELECT session_id, project, sum(length(text))::BIGINT AS size,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS modified, count(*) AS line_count,
      coalesce(arg_min(left(text, 100), turn) FILTER (WHERE role = 'user' AND turn < 10), '') AS first_message,
      CASE WHEN sum(length(text)) < 1024 THEN sum(length(text))::BIGINT || ' B'
        ELSE printf('%.1f KB', round(sum(length(text)) / 1024.0, 1)) END AS size_label
    FROM turns WHERE source = 'claude-code' GROUP BY session_id, project""",
)
def session_discovery(t: Tables) -> DataFrame:
    packed = _packed_claude(t).withColumn("file_path", F.col("session_id"))
    facts = t.turns.groupBy("session_id").agg(
        F.sum(F.length("text")).alias("file_size"), F.max("ts").alias("file_mtime")
    )
    found = R.discover_sessions(packed.join(facts, "session_id"))
    return found.select(
        "session_id", "project", "size", stamp("modified").alias("modified"), "line_count",
        F.coalesce("first_message", F.lit("")).alias("first_message"), X.size_label("size").alias("size_label"),
    )


@query(
    "project_counts",
    "SELECT project, count(DISTINCT session_id) AS session_count FROM a_msg GROUP BY project",
)
def project_counts(t: Tables) -> DataFrame:
    return S.project_counts(S.session_rollup(t.a_msg)).orderBy("project")


@query(
    "exclude_private",
    r"""SELECT session_id, msg_index, text FROM a_msg WHERE session_id NOT IN (
      SELECT session_id FROM a_msg WHERE regexp_matches(text, '(?:^|[^A-Za-z0-9_])(?:avec|mit|y)(?:$|[^A-Za-z0-9_])', 'i')
        OR cwd LIKE '%/p3' OR project = 'p5')""",
)
def exclude_private(t: Tables) -> DataFrame:
    private = S.private_sessions(
        t.a_msg, t.a_msg.select("session_id", "cwd"), [X.whole_words(["avec", "mit", "y"])], [r"/p3$"], ["^p5$"]
    )
    return S.without_sessions(t.a_msg, private).select("session_id", "msg_index", "text")


@query(
    "generation_store",
    """SELECT 'messages' AS held_in, session_id, msg_index AS position,
      CASE WHEN cwd LIKE '%/p3' THEN upper(text) ELSE text END AS body
    FROM a_msg WHERE project <> 'p5'
    UNION ALL
    SELECT DISTINCT 'session_files', session_id, 0, file_path FROM a_tool
    WHERE session_id NOT IN (SELECT session_id FROM a_msg WHERE project = 'p5')""",
)
def generation_store(t: Tables) -> DataFrame:
    """All messages and files stored; the sessions of one directory replaced, those of one project removed."""
    said = t.a_msg.select("session_id", F.col("msg_index").cast("long").alias("msg_index"), "text")
    kept = Store(t.spark, f"{shared_folder(t.spark)}/generations-{uuid.uuid4().hex}")
    kept.commit({"messages": said, "session_files": S.session_files(t.a_tool)})
    anew = t.a_msg.filter("cwd LIKE '%/p3'").select("session_id").distinct()
    fresh = {
        "messages": said.join(anew, "session_id", "left_semi").withColumn("text", F.upper("text")),
        "session_files": S.session_files(t.a_tool).join(anew, "session_id", "left_semi"),
    }
    kept.replace_sessions(anew, fresh)
    kept.forget(t.a_msg.filter("project = 'p5'").select("session_id"))
    kept.compact()
    kept.expire()
    messages = kept.read("messages").select(
        F.lit("messages").alias("held_in"), "session_id", F.col("msg_index").alias("position"), F.col("text").alias("body")
    )
    files = kept.read("session_files").select(
        F.lit("session_files"), "session_id", F.lit(0).cast("long"), "file_path"
    )
    return messages.union(files)


@query(
    "window_sessions",
    f"""SELECT session_id, project, msg_count, strftime(last_msg_at, '%Y-%m-%d %H:%M:%S') AS last_msg_at
    FROM ({SESSIONS_SQL}) WHERE last_msg_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-05'
      AND msg_count >= 3 AND project ILIKE '%P%' ORDER BY last_msg_at DESC, session_id LIMIT 25""",
)
def window_sessions(t: Tables) -> DataFrame:
    out = S.window_sessions(S.session_rollup(t.a_msg), DAY1, DAY4, project="P")
    return out.select("session_id", "project", "msg_count", stamp("last_msg_at").alias("last_msg_at"))


@query(
    "window_totals",
    f"""SELECT count(*) AS total_sessions, coalesce(sum(msg_count), 0)::BIGINT AS total_messages FROM (
      SELECT * FROM ({SESSIONS_SQL}) WHERE last_msg_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-05'
      AND msg_count >= 3)""",
)
def window_totals(t: Tables) -> DataFrame:
    return S.window_totals(S.window_sessions(S.session_rollup(t.a_msg), DAY1, DAY4, limit=None))


@query(
    "recent_sessions",
    f"""SELECT session_id, project, msg_count, strftime(last_msg_at, '%Y-%m-%d %H:%M:%S') AS last_msg_at,
      first_user_prompt FROM ({SESSIONS_SQL}) ORDER BY last_msg_at DESC NULLS LAST, session_id LIMIT 20""",
)
def recent_sessions(t: Tables) -> DataFrame:
    out = S.recent_sessions(S.session_rollup(t.a_msg))
    return out.select(
        "session_id", "project", "msg_count", stamp("last_msg_at").alias("last_msg_at"),
        F.coalesce("first_user_prompt", F.lit("")).alias("first_user_prompt"),
    )


@query("session_files", "SELECT DISTINCT session_id, file_path FROM a_tool")
def session_files(t: Tables) -> DataFrame:
    return S.session_files(t.a_tool)


@query(
    "sessions_by_file",
    """SELECT session_id, strftime(last_msg_at, '%Y-%m-%d %H:%M:%S') AS last_msg_at FROM (
      SELECT session_id, max(ts) AS last_msg_at FROM a_tool GROUP BY session_id)
    WHERE session_id IN (SELECT session_id FROM a_tool WHERE contains(lower(file_path), 'f7.'))
    ORDER BY last_msg_at DESC, session_id LIMIT 20""",
)
def sessions_by_file(t: Tables) -> DataFrame:
    sessions = t.a_tool.groupBy("session_id").agg(F.max("ts").alias("last_msg_at"))
    out = S.sessions_by_file(sessions, S.session_files(t.a_tool), "F7.")
    return out.select("session_id", stamp("last_msg_at").alias("last_msg_at"))


# --- content blocks ---------------------------------------------------------


def _blocks(t: Tables) -> DataFrame:
    """Tool log as content arrays: a text block, a call, and for errors a result."""
    text = F.struct(
        F.lit("text").alias("type"), F.concat(F.lit("run "), "tool").alias("text"),
    )
    call = F.to_json(
        F.struct(F.lit("tool_use").alias("type"), F.col("tool").alias("name"),
                 F.struct("file_path", F.col("props").alias("content")).alias("input"))
    )
    result = F.to_json(
        F.struct(F.lit("tool_result").alias("type"), F.col("is_error"), F.col("props").alias("content"))
    )
    rows = F.when(F.col("k") % 3 == 0, F.array(result)).when(
        F.col("is_error"), F.array(F.to_json(text), result)
    ).otherwise(F.array(F.to_json(text), call))
    return t.a_tool.select("session_id", "msg_index", "k", "tool", C.blocks_of(rows).alias("blocks"))


@query(
    "content_text",
    """SELECT session_id, msg_index,
      CASE WHEN k % 3 = 0 THEN '' ELSE 'run ' || tool END AS by_line,
      CASE WHEN k % 3 = 0 THEN '' ELSE 'run ' || tool END AS by_blank,
      CASE WHEN k % 3 = 0 THEN '' ELSE 'run ' || tool END AS by_paragraph
    FROM a_tool""",
)
def content_text(t: Tables) -> DataFrame:
    b, none = F.col("blocks"), F.lit(None).cast("string")
    return _blocks(t).select(
        "session_id", "msg_index",
        C.text_of(b, none).alias("by_line"),
        C.text_or_sentinel(b, none).alias("by_blank"),
        C.text_of(b, none, "\n\n").alias("by_paragraph"),
    )


@query(
    "prompt_kind",
    """SELECT session_id, msg_index, (k % 3 = 0 OR is_error) AS echoes_any, k % 3 = 0 AS echoes_all FROM a_tool""",
)
def prompt_kind(t: Tables) -> DataFrame:
    b = F.col("blocks")
    return _blocks(t).select(
        "session_id", "msg_index", C.echoes_any(b).alias("echoes_any"), C.echoes_all(b).alias("echoes_all")
    )


@query(
    "tool_calls",
    r"""SELECT session_id, msg_index, CASE WHEN k % 3 = 0 OR is_error THEN '' ELSE tool || ' ' ||
        left('{"file_path":"' || file_path || '","content":"' || replace(props, '"', '\"') || '"}', 200) END AS tool_calls,
      CASE WHEN k % 3 = 0 OR is_error THEN '' ELSE tool END AS tools
    FROM a_tool""",
)
def tool_calls(t: Tables) -> DataFrame:
    calls = C.tool_calls_of(F.col("blocks"))
    return _blocks(t).select(
        "session_id", "msg_index", C.render_calls(calls).alias("tool_calls"),
        F.array_join(F.transform(calls, lambda c: c["name"]), ",").alias("tools"),
    )


@query(
    "tool_files",
    """SELECT session_id, msg_index, file_path FROM a_tool WHERE k % 3 <> 0 AND NOT is_error""",
)
def tool_files(t: Tables) -> DataFrame:
    return _blocks(t).select("session_id", "msg_index", F.explode(C.files_of(F.col("blocks"))).alias("file_path"))
