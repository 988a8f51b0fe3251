"""Queries on signals, episodes, windows, turns and session edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import signals as G
from skein.operators import timeline as L
from skein.plans.adapters import TEST_WORDS, WORDS_RE, Tables, stamp
from skein.plans.registry import query

ERR = r"error|exception|traceback|failed|ENOTFOUND|ECONNREFUSED|exit code [1-9]|❌|\[TOOL ERROR\]"
FAIL = r"\[TOOL ERROR\]|command failed|exit code [1-9]"
COR = (
    r"(?:^|[^A-Za-z0-9_])(?:(?:not that|don''t do|that''s wrong|instead of|wait,? actually)(?:$|[^A-Za-z0-9_])"
    r"|(?:no,|stop |no —|no -)[A-Za-z0-9_])"
)
PIV = (
    r"(?:^|[^A-Za-z0-9_])(?:different approach|let me try|instead of|actually,? let''s|won''t work|alternative)(?:$|[^A-Za-z0-9_])"
)

SIGNALS_SQL = f"""
SELECT session_id, msg_index, role, text, regexp_matches(text, '{ERR}', 'i') AS has_error,
  regexp_matches(text, '{FAIL}', 'i') AS has_failure,
  role = 'user' AND length(text) < 500 AND regexp_matches(text, '{COR}', 'i') AS is_correction,
  role = 'assistant' AND regexp_matches(text, '{PIV}', 'i') AS is_pivot
FROM (SELECT session_id, msg_index, role, text FROM a_sig
  UNION ALL SELECT 'c' || session_id, msg_index, role, text FROM a_msg)"""


def spoken(t: Tables) -> DataFrame:
    """Tool log phrases and conversations as `role, text` messages."""
    said = t.a_msg.select(F.concat(F.lit("c"), "session_id").alias("session_id"), "msg_index", "role", "text")
    return t.a_sig.select("session_id", "msg_index", "role", "text").unionByName(said)


@query("message_signals", SIGNALS_SQL)
def message_signals(t: Tables) -> DataFrame:
    return G.message_signals(spoken(t))


@query(
    "decision_cues",
    f"""SELECT session_id, msg_index, length(assistant_text) AS chars FROM a_msg
    WHERE length(assistant_text) > 80 AND regexp_matches(assistant_text, '{WORDS_RE}', 'i')""",
)
def decision_cues(t: Tables) -> DataFrame:
    return t.a_msg.filter(G.decides(F.col("assistant_text"), TEST_WORDS)).select(
        "session_id", "msg_index", F.length("assistant_text").alias("chars")
    )


@query(
    "likely_decisions",
    f"""SELECT session_id, msg_index // 3 AS window_no,
      regexp_matches(string_agg(text, ' ' ORDER BY msg_index), '{WORDS_RE}', 'i') AS likely
    FROM a_msg GROUP BY ALL""",
)
def likely_decisions(t: Tables) -> DataFrame:
    rows = t.a_msg.withColumn("tools", F.array().cast("array<string>"))
    return L.likely_decisions(rows, 3, [X.whole_words(TEST_WORDS)[4:]])


# the tool log as raw lines: errors are results that wait for the next message
ENTRIES_SQL = f"""
lines AS (SELECT session_id, msg_index AS line_no, CASE WHEN NOT is_error THEN role END AS role, text FROM a_sig),
slots AS (SELECT *, sum(CASE WHEN role IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no)
    - CASE WHEN role IS NOT NULL THEN 1 ELSE 0 END AS slot FROM lines),
errs AS (SELECT session_id, slot, count(*) AS n, string_agg(chr(10) || '[TOOL ERROR]: ' || text, '' ORDER BY line_no) AS txt
  FROM slots WHERE role IS NULL GROUP BY session_id, slot),
whole AS (SELECT s.session_id, s.line_no, s.role, s.text || coalesce(e.txt, '') AS text, coalesce(e.n, 0) AS n_errors
  FROM slots s LEFT JOIN errs e ON e.session_id = s.session_id AND e.slot = s.slot WHERE s.role IS NOT NULL),
flagged AS (SELECT session_id, line_no, role, left(text, 3000) AS content, n_errors,
  regexp_matches(text, '{ERR}', 'i') AS has_error, regexp_matches(text, '{FAIL}', 'i') AS has_failure,
  role = 'user' AND length(text) < 500 AND regexp_matches(text, '{COR}', 'i') AS is_correction,
  role = 'assistant' AND regexp_matches(text, '{PIV}', 'i') AS is_pivot,
  row_number() OVER (PARTITION BY session_id ORDER BY line_no) - 1 AS pos
  FROM whole),
anchors AS (SELECT *, CASE WHEN has_failure THEN 'tool_failure' WHEN has_error THEN 'error_recovery'
    WHEN is_correction THEN 'user_correction' WHEN is_pivot THEN 'approach_pivot' END AS signal
  FROM flagged WHERE has_failure OR has_error OR is_correction OR is_pivot)"""


def flagged(t: Tables) -> DataFrame:
    entries = t.a_sig.select(
        "session_id", F.col("msg_index").alias("line_no"), F.when(~F.col("is_error"), F.col("role")).alias("role"), "text"
    )
    return G.carry_errors(entries)


@query("carry_errors", f"WITH {ENTRIES_SQL} SELECT * FROM flagged")
def carry_errors(t: Tables) -> DataFrame:
    return flagged(t)


@query("anchors", f"WITH {ENTRIES_SQL} SELECT session_id, pos, line_no, signal FROM anchors")
def anchors(t: Tables) -> DataFrame:
    return G.anchors(flagged(t)).select("session_id", "pos", "line_no", "signal")


@query(
    "episodes",
    f"""WITH RECURSIVE {ENTRIES_SQL},
    n AS (SELECT session_id, count(*) AS n FROM flagged GROUP BY session_id),
    wins AS (SELECT a.session_id, pos, signal, greatest(pos - 4, 0) AS s, least(pos + 15, n - 1) AS e FROM anchors a JOIN n USING (session_id)),
    pairs AS (SELECT a.session_id, a.pos, min(b.pos) AS nxt FROM wins a JOIN wins b ON a.session_id = b.session_id
      AND b.pos > a.pos AND greatest(a.e - b.s + 1, 0) <= 0.5 * (b.e - b.s + 1) GROUP BY a.session_id, a.pos),
    kept AS (SELECT session_id, min(pos) AS pos FROM wins GROUP BY session_id
      UNION ALL SELECT p.session_id, p.nxt FROM kept k JOIN pairs p ON p.session_id = k.session_id AND p.pos = k.pos),
    eps AS (SELECT w.* FROM wins w JOIN kept USING (session_id, pos))
    SELECT e.session_id, e.pos AS anchor, e.signal, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_messages,
      string_agg(left(content, 100), ' | ' ORDER BY f.pos) FILTER (WHERE f.pos < e.s + 3) AS summary,
      string_agg('[' || role || CASE WHEN has_error THEN ' ERROR' ELSE '' END || CASE WHEN is_correction THEN ' CORRECTION' ELSE '' END
        || CASE WHEN is_pivot THEN ' PIVOT' ELSE '' END || ']: ' || content, chr(10) || chr(10) ORDER BY f.pos) AS request
    FROM eps e JOIN flagged f ON f.session_id = e.session_id AND f.pos BETWEEN e.s AND e.e
    GROUP BY e.session_id, e.pos, e.signal""",
)
def episodes(t: Tables) -> DataFrame:
    return G.episodes(flagged(t))


# --- windows, turns, edges --------------------------------------------------


@query(
    "message_windows",
    """SELECT session_id, msg_index // 5 AS window_no, count(*) AS n_messages,
      strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
      string_agg(role || ': ' || left(text, 500), chr(10) ORDER BY msg_index) AS body,
      string_agg(tool, ',' ORDER BY msg_index) AS tools, string_agg(file_path, ',' ORDER BY msg_index) AS files
    FROM (SELECT s.*, file_path FROM a_sig s JOIN a_tool USING (session_id, msg_index))
    GROUP BY session_id, msg_index // 5 HAVING count(*) = 5""",
)
def message_windows(t: Tables) -> DataFrame:
    files = t.a_tool.select("session_id", "msg_index", F.array("file_path").alias("files"))
    rows = t.a_sig.withColumn("tools", F.array("tool")).join(files, ["session_id", "msg_index"])
    out = L.message_windows(rows, 5)
    return out.withColumn("first_ts", stamp("first_ts")).withColumn("last_ts", stamp("last_ts"))


TURNS_SQL = """
rows AS (SELECT session_id, turn AS pos, role, text, role = 'user' AND turn % 4 = 2 AS is_echo, length(text) % 7 = 0 AS is_meta FROM turns),
lagged AS (SELECT *, coalesce(lag(is_echo) OVER (PARTITION BY session_id ORDER BY pos), false) AS after_echo FROM rows),
kept AS (SELECT *, lag(role) OVER (PARTITION BY session_id ORDER BY pos) AS prev FROM lagged WHERE NOT is_echo),
numbered AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> role OR role = 'system' OR (role = 'user' AND after_echo) THEN 1 ELSE 0 END)
    OVER (PARTITION BY session_id ORDER BY pos)::BIGINT AS turn_no FROM kept),
heads AS (SELECT session_id, turn_no, min(pos) FILTER (role <> 'user' OR NOT is_meta) AS head FROM numbered GROUP BY ALL),
assigned AS (SELECT n.* FROM numbered n JOIN heads h ON h.session_id = n.session_id AND h.turn_no = n.turn_no AND n.pos >= h.head)"""


def _turns(t: Tables) -> DataFrame:
    rows = t.turns.select(
        "session_id", F.col("turn").alias("pos"), "role", "text",
        ((F.col("role") == "user") & (F.col("turn") % 4 == 2)).alias("is_echo"), (F.length("text") % 7 == 0).alias("is_meta"),
    )
    return L.assign_turns(rows)


@query(
    "turns",
    f"""WITH {TURNS_SQL} SELECT session_id, turn_no, arg_min(role, pos) AS role, min(pos) AS first_pos, max(pos) AS last_pos,
      count(*) AS n_messages, sum(length(text))::BIGINT AS chars FROM assigned GROUP BY session_id, turn_no""",
)
def turns(t: Tables) -> DataFrame:
    return L.turn_table(_turns(t))


@query("turn_messages", f"WITH {TURNS_SQL} SELECT session_id, turn_no, pos, role, text FROM assigned")
def turn_messages(t: Tables) -> DataFrame:
    return _turns(t).select("session_id", "turn_no", "pos", "role", "text")


@query(
    "pages_index",
    """SELECT session_id, page, total_pages, first_index, n_messages, coalesce(phase_name, '') AS current_phase,
      CASE WHEN page > 1 THEN 'page-' || lpad(CAST(page - 1 AS VARCHAR), 3, '0') || '.html' ELSE '' END AS prev_page,
      CASE WHEN page < total_pages THEN 'page-' || lpad(CAST(page + 1 AS VARCHAR), 3, '0') || '.html' ELSE '' END AS next_page
    FROM (SELECT session_id, msg_index // 3 + 1 AS page, min(msg_index) AS first_index, count(*) AS n_messages,
        max(max(msg_index // 3 + 1)) OVER (PARTITION BY session_id) AS total_pages FROM a_msg GROUP BY session_id, msg_index // 3)
    LEFT JOIN (SELECT session_id, msg_index AS first_index, phase_name FROM a_phase) USING (session_id, first_index)""",
)
def pages_index(t: Tables) -> DataFrame:
    return L.pages(t.a_msg, t.a_phase, 3)


@query(
    "session_opening",
    """SELECT session_id, max(left(user_text, 500)) FILTER (n = 1) AS initial_request,
      coalesce(string_agg(left(user_text, 200), ' / ' ORDER BY n) FILTER (n > 1), '') AS early_context
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_index) AS n FROM a_msg WHERE is_human_prompt)
    WHERE n <= 5 GROUP BY session_id""",
)
def session_opening(t: Tables) -> DataFrame:
    return L.session_opening(t.a_msg).withColumn("early_context", F.array_join("early_context", " / "))


@query(
    "session_ending",
    """SELECT session_id, string_agg(left(text, 200), ' / ' ORDER BY msg_index) AS final_messages,
      (SELECT string_agg(x, ',' ORDER BY p) FROM (SELECT tool AS x, min(msg_index) AS p FROM last l2
        WHERE l2.session_id = last.session_id GROUP BY tool)) AS final_tools
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_index DESC) AS n FROM a_sig WHERE role = 'assistant') AS last
    WHERE n <= 3 GROUP BY session_id""".replace("FROM last l2", "FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_index DESC) AS n FROM a_sig WHERE role = 'assistant') AS l2").replace("l2.session_id = last.session_id", "l2.n <= 3 AND l2.session_id = last.session_id"),
)
def session_ending(t: Tables) -> DataFrame:
    out = L.session_ending(t.a_sig.withColumn("tools", F.array("tool")))
    return out.select(
        "session_id", F.array_join("final_messages", " / ").alias("final_messages"), F.array_join("final_tools", ",").alias("final_tools")
    )


@query(
    "message_gaps",
    """SELECT session_id, msg_index, coalesce(epoch(date_trunc('second', ts)) - epoch(date_trunc('second',
        lag(ts) OVER (PARTITION BY session_id ORDER BY msg_index))), 0)::BIGINT AS gap_seconds,
      round(msg_index / count(*) OVER (PARTITION BY session_id), 6) AS share_before FROM a_tool""",
)
def message_gaps(t: Tables) -> DataFrame:
    return L.message_gaps(t.a_tool)


@query(
    "numbered_transcript",
    """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS message_no, upper(role) AS speaker,
      CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...[truncated]' ELSE text END AS text, length(text) > 1000 AS was_cut
    FROM turns WHERE role <> 'system'""",
)
def numbered_transcript(t: Tables) -> DataFrame:
    return L.numbered_transcript(t.turns.select("session_id", F.col("turn").alias("line_no"), F.col("role").alias("type"), "text"))


@query("type_histogram", "SELECT session_id, role AS type, count(*) AS messages FROM turns GROUP BY session_id, role")
def type_histogram(t: Tables) -> DataFrame:
    return L.type_histogram(t.turns.withColumnRenamed("role", "type"))


@query(
    "session_metadata",
    """SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_time,
      count(*) AS message_count, count(*) FILTER (role = 'user') AS user_message_count, count(DISTINCT tool) AS tools_used,
      coalesce((SELECT count(DISTINCT phase_id) FROM a_phase p WHERE p.session_id = s.session_id), 0) AS phase_count,
      CASE WHEN m < 1 THEN '< 1 min' WHEN m < 60 THEN m || ' min' WHEN m % 60 > 0 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE (m // 60) || 'h' END AS duration,
      CASE WHEN r < 60 THEN r || ' min' WHEN r % 60 > 0 THEN (r // 60) || 'h ' || (r % 60) || 'm' ELSE (r // 60) || 'h' END AS duration_rounded
    FROM (SELECT *, floor((epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w)) / 60000000.0)::BIGINT AS m,
        floor((epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w)) / 60000000.0 + 0.5)::BIGINT AS r
      FROM a_sig WINDOW w AS (PARTITION BY session_id)) s GROUP BY session_id, m, r""",
)
def session_metadata(t: Tables) -> DataFrame:
    out = L.session_metadata(t.a_sig.withColumn("tools", F.array("tool")), t.a_phase)
    return out.withColumn("start_time", stamp("start_time")).withColumn("end_time", stamp("end_time"))
