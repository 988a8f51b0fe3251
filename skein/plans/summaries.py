"""Queries on digests, annotations and session summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import annotations as N
from skein.operators import artifacts as A
from skein.operators import digest as D
from skein.operators import sessions as S
from skein.operators import tools as W
from skein.plans.adapters import TEST_WORDS, WORDS_RE, Tables, stamp
from skein.plans.ingest import SESSIONS_SQL
from skein.plans.registry import query
from skein.plans.toolwork import TRANSITIONS_SQL, _entries, _transitions

TOP_PROMPTS_SQL = """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY length(user_text) DESC, msg_index) AS rank, msg_index,
  CASE WHEN length(user_text) > 400 THEN left(user_text, 399) || '…' ELSE user_text END AS text
FROM a_msg WHERE length(user_text) > 30 AND msg_index > 0 QUALIFY rank <= 5"""
TOP_DECISIONS_SQL = f"""
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY length(assistant_text) DESC, msg_index) AS rank, msg_index,
  CASE WHEN length(assistant_text) > 400 THEN left(assistant_text, 399) || '…' ELSE assistant_text END AS text
FROM a_msg WHERE length(assistant_text) > 80 AND regexp_matches(assistant_text, '{WORDS_RE}', 'i') QUALIFY rank <= 3"""


@query("top_prompts", TOP_PROMPTS_SQL)
def top_prompts(t: Tables) -> DataFrame:
    return D.top_prompts(t.a_msg).drop("ts")


@query("top_decisions", TOP_DECISIONS_SQL)
def top_decisions(t: Tables) -> DataFrame:
    return D.top_decisions(t.a_msg, cues=TEST_WORDS).drop("ts")


WINDOW_SQL = f"""
win AS (SELECT * FROM ({SESSIONS_SQL}) WHERE last_msg_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-06-01'
  AND msg_count >= 3 ORDER BY last_msg_at DESC, session_id LIMIT 25),
pr AS ({TOP_PROMPTS_SQL}), de AS ({TOP_DECISIONS_SQL}),
tl AS (SELECT session_id, tool, count(*) AS calls, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, tool) AS rank FROM a_tool GROUP BY session_id, tool),
fl AS (SELECT session_id, file_path, row_number() OVER (PARTITION BY session_id ORDER BY min(msg_index), file_path) AS rank
  FROM a_tool GROUP BY session_id, file_path QUALIFY rank <= 15)"""


def _digest(t: Tables) -> DataFrame:
    chosen = S.window_sessions(S.session_rollup(t.a_msg), datetime(2024, 1, 1), datetime(2024, 6, 1))
    return D.window_digest(chosen, t.a_msg, t.a_tool, TEST_WORDS)


@query(
    "window_digest",
    f"""WITH {WINDOW_SQL}
    SELECT session_id, project, msg_count,
      coalesce((SELECT string_agg(msg_index || ':' || text, ' | ' ORDER BY rank) FROM pr WHERE pr.session_id = win.session_id), '') AS user_prompts,
      coalesce((SELECT string_agg(msg_index || ':' || text, ' | ' ORDER BY rank) FROM de WHERE de.session_id = win.session_id), '') AS assistant_decisions,
      coalesce((SELECT string_agg(tool || '×' || calls, ', ' ORDER BY rank) FROM tl WHERE tl.session_id = win.session_id), '') AS tools,
      coalesce((SELECT string_agg(file_path, ', ' ORDER BY rank) FROM fl WHERE fl.session_id = win.session_id), '') AS files_touched
    FROM win""",
)
def window_digest(t: Tables) -> DataFrame:
    def texts(name: str):
        return F.coalesce(F.array_join(F.transform(name, lambda p: F.concat_ws(":", p["msg_index"], p["text"])), " | "), F.lit(""))

    return _digest(t).select(
        "session_id", "project", "msg_count", texts("user_prompts").alias("user_prompts"),
        texts("assistant_decisions").alias("assistant_decisions"),
        F.coalesce(F.array_join(F.transform("tools", lambda x: F.concat_ws("×", x["tool"], x["calls"])), ", "), F.lit("")).alias("tools"),
        F.coalesce(F.array_join("files_touched", ", "), F.lit("")).alias("files_touched"),
    )


def _line(text: str) -> str:
    flat = f"regexp_replace({text}, '\\s+', ' ', 'g')"
    return f"'- [' || left(session_id, 8) || ':' || msg_index || '] ' || CASE WHEN length({flat}) > 240 THEN left({flat}, 239) || '…' ELSE {flat} END"


@query(
    "digest_lines",
    f"""WITH {WINDOW_SQL}
    SELECT session_id, 0 AS section, 0 AS pos, '---' AS line FROM win
    UNION ALL SELECT session_id, 0, 1, '## [' || left(session_id, 8) || '] ' || project || '   (' || strftime(last_msg_at, '%Y-%m-%d %H:%M') || ', ' || msg_count || ' msgs, source=' || source || ')' FROM win
    UNION ALL SELECT session_id, 1, 0, 'First prompt: ' || CASE WHEN length(first_user_prompt) > 160 THEN left(first_user_prompt, 159) || '…' ELSE first_user_prompt END FROM win WHERE first_user_prompt <> ''
    UNION ALL SELECT session_id, 2, 0, '### Notable user prompts' FROM win SEMI JOIN pr USING (session_id)
    UNION ALL SELECT session_id, 2, rank, {_line('text')} FROM pr SEMI JOIN win USING (session_id)
    UNION ALL SELECT session_id, 3, 0, '### Assistant decisions / pivots' FROM win SEMI JOIN de USING (session_id)
    UNION ALL SELECT session_id, 3, rank, {_line('text')} FROM de SEMI JOIN win USING (session_id)
    UNION ALL SELECT session_id, 4, 0, '### Tool signature: ' || string_agg(tool || '×' || calls, ', ' ORDER BY rank) FROM tl SEMI JOIN win USING (session_id) WHERE rank <= 6 GROUP BY session_id
    UNION ALL SELECT session_id, 5, 0, '### Files touched: ' || string_agg(file_path, ', ' ORDER BY rank) FROM fl SEMI JOIN win USING (session_id) GROUP BY session_id""",
)
def digest_lines(t: Tables) -> DataFrame:
    return D.digest_lines(_digest(t))


@query(
    "prior_window",
    """WITH w AS (SELECT conv_id % 50 AS g, session_id AS name, min(ts) AS "start", max(ts) AS "end" FROM a_msg GROUP BY ALL)
    SELECT a.name, strftime(a."start", '%Y-%m-%d %H:%M:%S') AS "start", coalesce(b.name, '') AS prior_name,
      coalesce(strftime(b."end", '%Y-%m-%d %H:%M:%S'), '') AS prior_end
    FROM w a LEFT JOIN w b ON b."end" < a."start"
    QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY b."end" DESC NULLS LAST, b.name DESC) = 1""",
)
def prior_window(t: Tables) -> DataFrame:
    windows = t.a_msg.groupBy(F.col("session_id").alias("name")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return D.prior_windows(windows).select(
        "name", stamp("start").alias("start"), F.coalesce("prior_name", F.lit("")).alias("prior_name"),
        F.coalesce(stamp("prior_end"), F.lit("")).alias("prior_end"),
    )


# --- single session digest --------------------------------------------------

DECISIVE = ["Write"]


def _session_digest(t: Tables) -> DataFrame:
    messages = t.a_sig.withColumn("tools", F.array("tool"))
    calls = t.a_tool.join(t.a_sig.select("session_id", "msg_index", "text"), ["session_id", "msg_index"])
    return D.session_digest(messages, calls, DECISIVE, _transitions(t))


SESSION_DIGEST_SQL = f"""{TRANSITIONS_SQL},
us AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_index) AS n FROM a_sig WHERE role = 'user' QUALIFY n <= 5),
la AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_index DESC) AS n FROM a_sig WHERE role = 'assistant' QUALIFY n <= 3),
fa AS (SELECT session_id, count(DISTINCT file_path) FILTER (tool = 'Write') AS created, count(DISTINCT file_path) FILTER (tool = 'Edit') AS modified,
  least(count(DISTINCT file_path) FILTER (tool = 'Read'), 10) AS rd, count(*) FILTER (tool = 'Write') AS decisions, max(msg_index) AS last,
  count(*) AS total_messages, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 + 0.5)::BIGINT AS duration_minutes FROM a_tool GROUP BY session_id),
dig AS (SELECT session_id, total_messages, duration_minutes, created, modified, rd, decisions,
  coalesce((SELECT count(*) FROM tr WHERE tr.session_id = fa.session_id), 0) AS transitions,
  (SELECT max(text) FROM us WHERE us.session_id = fa.session_id AND n = 1) AS initial_request,
  (SELECT string_agg(text, ' / ' ORDER BY n) FROM us WHERE us.session_id = fa.session_id AND n > 1) AS early_context,
  (SELECT string_agg(text, ' / ' ORDER BY msg_index) FROM la WHERE la.session_id = fa.session_id) AS final_messages FROM fa)"""


@query(
    "session_digest",
    f"""WITH {SESSION_DIGEST_SQL} SELECT session_id, total_messages, duration_minutes, created AS files_created, modified AS files_modified,
      rd AS files_read, decisions, transitions, initial_request, early_context, final_messages FROM dig""",
)
def session_digest(t: Tables) -> DataFrame:
    return _session_digest(t).select(
        "session_id", "total_messages", "duration_minutes", "files_created", "files_modified", "files_read",
        "decisions", "transitions", "initial_request", F.array_join("early_context", " / ").alias("early_context"),
        F.array_join("final_messages", " / ").alias("final_messages"),
    )


@query(
    "review_lines",
    f"""WITH {SESSION_DIGEST_SQL},
    ts AS (SELECT session_id, tool, count(*) AS calls, min(msg_index) AS f, max(msg_index) AS l FROM a_tool GROUP BY ALL),
    ac AS (SELECT session_id, tool, file_path, min(msg_index) AS f FROM a_tool WHERE tool IN ('Write', 'Edit') GROUP BY ALL)
    SELECT session_id, 0 AS section, 1 AS pos, 'Goal: "' || initial_request || '"' AS line FROM dig
    UNION ALL SELECT session_id, 0, 2, 'Duration: ~' || duration_minutes || ' minutes' FROM dig
    UNION ALL SELECT session_id, 0, 3, 'Total messages: ' || total_messages FROM dig
    UNION ALL SELECT session_id, 1, row_number() OVER (PARTITION BY session_id ORDER BY calls DESC, tool) AS p,
      '- ' || tool || ': ' || calls || 'x (first at msg ' || f || ', last at ' || l || ')' FROM ts QUALIFY p <= 12
    UNION ALL SELECT session_id, 2, row_number() OVER (PARTITION BY session_id ORDER BY f, file_path) AS p, '  - ' || file_path FROM ac WHERE tool = 'Write' QUALIFY p <= 20
    UNION ALL SELECT session_id, 4, row_number() OVER (PARTITION BY session_id ORDER BY msg_index) AS p, '- Message ' || msg_index || ' [' || tool || ']: ' || text
      FROM a_sig WHERE tool = 'Write' QUALIFY p <= 5
    UNION ALL SELECT session_id, 5, msg_index, '- Message ' || msg_index || ': ' || indicator FROM tr
    UNION ALL SELECT session_id, 6, row_number() OVER (PARTITION BY session_id ORDER BY msg_index), text FROM la""",
)
def review_lines(t: Tables) -> DataFrame:
    calls = t.a_sig.select("session_id", "msg_index", "tool", "text")
    return D.review_lines(
        _session_digest(t), W.tool_summary(t.a_tool), W.file_activity(t.a_tool), W.decision_points(calls, DECISIVE),
        _transitions(t), D.REVIEW_CAPS["approach"],
    )


# --- annotations ------------------------------------------------------------


@query(
    "group_by_phase",
    """SELECT m.session_id, m.msg_index, coalesce(p.phase_id, -1) AS phase_id FROM a_msg m LEFT JOIN a_phase p
      ON p.session_id = m.session_id AND p.msg_index = m.msg_index""",
)
def group_by_phase(t: Tables) -> DataFrame:
    return N.phase_of(t.a_msg.select("session_id", "msg_index"), t.a_phase)


@query(
    "color_stats",
    """SELECT session_id, count(*) AS annotated, count(*) FILTER (color = 'green') AS green_count, count(*) FILTER (color = 'yellow') AS yellow_count,
      count(*) FILTER (color = 'red') AS red_count, floor(count(*) FILTER (color = 'green') / count(*) * 100 + 0.5)::BIGINT || '%' AS green_share,
      count(*) || CASE WHEN count(*) = 1 THEN ' key moment' ELSE ' key moments' END AS label FROM a_ann GROUP BY session_id""",
)
def color_stats(t: Tables) -> DataFrame:
    return N.color_stats(t.a_ann)


KEY_SQL = """SELECT session_id, msg_index, content, annotation, color, reasoning, phase_id FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, color, length(content) > 100 ORDER BY msg_index) AS n FROM a_ann)
  WHERE color IN ('green', 'red') OR (length(content) > 100 AND n <= 2)"""


@query("key_prompts", KEY_SQL)
def key_prompts(t: Tables) -> DataFrame:
    return N.key_prompts(t.a_ann, yellow=2)


@query(
    "key_moments",
    """SELECT a.session_id, a.msg_index, annotation, color,
      CASE WHEN floor(epoch(m.ts - s) / 60 + 0.5) > 0 THEN floor(epoch(m.ts - s) / 60 + 0.5)::BIGINT || ' min' ELSE 'Start' END AS "time",
      CASE WHEN floor(epoch(m.ts - s) / 60) < 1 THEN '0 min' ELSE floor(epoch(m.ts - s) / 60)::BIGINT || ' min' END AS "offset",
      'page-' || lpad(CAST(a.msg_index // 50 + 1 AS VARCHAR), 3, '0') || '.html#msg-' || a.msg_index AS link
    FROM a_ann a JOIN a_msg m USING (session_id, msg_index) JOIN (SELECT session_id, min(ts) AS s FROM a_msg GROUP BY session_id) x ON x.session_id = a.session_id""",
)
def key_moments(t: Tables) -> DataFrame:
    starts = t.a_msg.groupBy("session_id").agg(F.min("ts").alias("started"))
    return N.key_moments(t.a_ann, t.a_msg, starts)


@query(
    "key_messages",
    """SELECT m.session_id, m.msg_index, coalesce(annotation, '') AS annotation, annotation IS NOT NULL AS is_key FROM a_msg m LEFT JOIN a_ann a
      ON a.session_id = m.session_id AND a.msg_index = m.msg_index""",
)
def key_messages(t: Tables) -> DataFrame:
    out = N.mark_key_messages(t.a_msg.select("session_id", "msg_index"), t.a_ann)
    return out.select("session_id", "msg_index", F.coalesce("annotation", F.lit("")).alias("annotation"), "is_key")


@query(
    "annotation_context",
    """WITH u AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_index) - 1 AS user_no FROM a_ann)
    SELECT u.session_id, u.msg_index, u.user_no,
      coalesce((SELECT string_agg(p.msg_index || '. ' || CASE WHEN length(p.content) > 150 THEN left(p.content, 150) || '...' ELSE p.content END, chr(10) ORDER BY p.user_no)
        FROM u p WHERE p.session_id = u.session_id AND p.user_no BETWEEN u.user_no - 3 AND u.user_no - 1), '') AS prior_messages,
      CASE WHEN length(content) > 300 THEN left(content, 300) || '...' ELSE content END AS current, phase_name,
      u.msg_index = min(u.msg_index) OVER (PARTITION BY u.session_id, u.phase_id) AS first_in_phase
    FROM u JOIN a_phase f ON f.session_id = u.session_id AND f.msg_index = u.msg_index""",
)
def annotation_context(t: Tables) -> DataFrame:
    prompts = t.a_ann.select("session_id", "msg_index", "content")
    return N.annotation_context(prompts, t.a_phase)


@query(
    "phase_requests",
    """SELECT session_id, row_number() OVER w - 1 AS user_no, (row_number() OVER w - 1) || '. ' ||
      CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS line
    FROM a_ann WINDOW w AS (PARTITION BY session_id ORDER BY msg_index)""",
)
def phase_requests(t: Tables) -> DataFrame:
    return N.phase_requests(t.a_ann.select("session_id", "msg_index", "content"), cap=200)


GOAL_SQL = r"""
ids AS (SELECT DISTINCT session_id FROM a_msg),
u AS (SELECT session_id, min(msg_index) AS ui, arg_min(user_text, msg_index) AS ut FROM a_msg WHERE is_human_prompt GROUP BY session_id),
p AS (SELECT session_id, arg_min(phase_name, phase_id) AS pn, arg_min(description, phase_id) AS pd, arg_max(phase_name, phase_id) AS ln,
  arg_max(description, phase_id) AS ld, count(DISTINCT phase_id) AS pc FROM a_phase GROUP BY session_id),
g AS (SELECT session_id, min(msg_index) AS gi, arg_min(annotation, msg_index) AS ga, arg_min(content, msg_index) AS gc, count(*) AS gn FROM a_ann WHERE color = 'green' GROUP BY session_id),
j AS (SELECT *, regexp_replace(regexp_split_to_array(ut, '[.!?]')[1], '^\s+|\s+$', '', 'g') AS sen
  FROM ids LEFT JOIN u USING (session_id) LEFT JOIN p USING (session_id) LEFT JOIN g USING (session_id))"""


GOAL_SELECT = """CASE WHEN pn IS NOT NULL AND ut IS NOT NULL THEN CASE WHEN length(pn) BETWEEN 21 AND 99 THEN pn || '. ' || pd WHEN length(sen) < 200 THEN sen ELSE pd END
        WHEN ga IS NOT NULL THEN ga || ': ' || left(gc, 300) WHEN ut IS NOT NULL THEN CASE WHEN length(sen) < 300 THEN sen ELSE left(ut, 300) END
        ELSE 'Session analysis' END"""


@query(
    "session_goal",
    f"""WITH {GOAL_SQL} SELECT session_id, {GOAL_SELECT} AS goal,
      CASE WHEN pn IS NOT NULL AND ut IS NOT NULL THEN ui WHEN ga IS NOT NULL THEN gi ELSE coalesce(ui, 0) END AS goal_index,
      CASE WHEN pn IS NOT NULL THEN 'annotation' ELSE 'first_message' END AS goal_source FROM j""",
)
def session_goal(t: Tables) -> DataFrame:
    return N.session_goal(t.a_msg, t.a_phase, t.a_ann)


OUTCOME_SELECT = """CASE WHEN ln IS NOT NULL THEN 'Completed ' || lower(ln) || '. ' || CASE WHEN ld <> ln AND length(ld) > 30 THEN ld ELSE '' END
        || CASE WHEN pc > 1 THEN ' Overall, worked through ' || pc || ' distinct phases' || CASE WHEN coalesce(gn, 0) > 0 THEN ' covering ' || gn || ' major tasks' ELSE '' END || '.' ELSE '' END
        WHEN lt IS NOT NULL THEN 'Session ended with: ' || left(lt, 400) ELSE 'Session completed' END"""
LAST_SQL = """lu AS (SELECT session_id, string_agg(user_text, ' ' ORDER BY msg_index) AS lt FROM (SELECT *, row_number() OVER (PARTITION BY session_id
      ORDER BY msg_index DESC) AS n FROM a_msg WHERE is_human_prompt) WHERE n <= 2 GROUP BY session_id)"""


@query(
    "session_outcome",
    f"""WITH {GOAL_SQL}, {LAST_SQL}
    SELECT session_id, {OUTCOME_SELECT} AS outcome, CASE WHEN ln IS NOT NULL THEN 'last_phase' ELSE 'last_messages' END AS outcome_source
    FROM j LEFT JOIN lu USING (session_id)""",
)
def session_outcome(t: Tables) -> DataFrame:
    return N.session_outcome(t.a_msg, t.a_phase, t.a_ann)


def _blog(t: Tables) -> tuple[DataFrame, DataFrame]:
    messages = t.a_msg.withColumn("tools", F.array().cast("array<string>"))
    snippets = A.code_snippets(A.explode_blocks(_entries(t)))
    return N.blog_summary(messages, t.a_phase, t.a_ann, snippets)


@query(
    "blog_summary",
    f"""WITH {GOAL_SQL}, {LAST_SQL},
    md AS (SELECT session_id, count(*) AS message_count, count(*) FILTER (is_human_prompt) AS user_message_count,
      CASE WHEN epoch(max(ts) - min(ts)) < 60 THEN '< 1 min' ELSE floor(epoch(max(ts) - min(ts)) / 60)::BIGINT || ' min' END AS duration FROM a_msg GROUP BY session_id)
    SELECT session_id, message_count, user_message_count, coalesce(pc, 0) AS phase_count, duration, {GOAL_SELECT} AS goal, {OUTCOME_SELECT} AS outcome
    FROM j JOIN md USING (session_id) LEFT JOIN lu USING (session_id)""",
)
def blog_summary(t: Tables) -> DataFrame:
    head, _ = _blog(t)
    return head.select("session_id", "message_count", "user_message_count", "phase_count", "duration", "goal", "outcome")


@query(
    "blog_prompts",
    """WITH kp AS (SELECT session_id, msg_index, content FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id, color, length(content) > 100 ORDER BY msg_index) AS n FROM a_ann)
      WHERE color IN ('green', 'red') OR (length(content) > 100 AND n <= 5))
    SELECT k.session_id, coalesce(p.phase_id, -1) AS phase_id, k.msg_index, content AS text,
      'page-' || lpad(CAST(k.msg_index // 50 + 1 AS VARCHAR), 3, '0') || '.html#msg-' || k.msg_index AS link
    FROM kp k LEFT JOIN a_phase p ON p.session_id = k.session_id AND p.msg_index = k.msg_index""",
)
def blog_prompts(t: Tables) -> DataFrame:
    _, items = _blog(t)
    return items.filter("kind = 'prompt'").drop("kind")
