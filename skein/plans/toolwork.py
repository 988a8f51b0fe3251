"""Queries on tool statistics, chunks, phases and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import content as C
from skein.operators import artifacts as A
from skein.operators import timeline as L
from skein.operators import tools as W
from skein.plans.adapters import Tables
from skein.plans.registry import query

SIZE = 20

INPUT = r"""('{"file_path":"' || file_path || '","content":"' || replace(props, '"', '\"') || '"}')"""


@query("tool_totals", "SELECT session_id, tool, count(*) AS calls FROM a_tool GROUP BY session_id, tool")
def tool_totals(t: Tables) -> DataFrame:
    return W.tool_totals(t.a_tool)


@query(
    "tool_map",
    """SELECT session_id, string_agg(tool || '=' || n, ',' ORDER BY tool) AS totals
    FROM (SELECT session_id, tool, count(*) AS n FROM a_tool GROUP BY ALL) GROUP BY session_id""",
)
def tool_map(t: Tables) -> DataFrame:
    pairs = F.transform(F.map_entries("totals"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return W.tool_map(t.a_tool).select("session_id", F.array_join(pairs, ",").alias("totals"))


@query(
    "top_tools",
    """SELECT session_id, tool, count(*) AS calls, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, tool) AS rank
    FROM a_tool GROUP BY session_id, tool QUALIFY rank <= 3""",
)
def top_tools(t: Tables) -> DataFrame:
    return W.top_tools(t.a_tool, 3)


@query(
    "files_touched",
    """SELECT session_id, file_path, min(msg_index) AS first_seen, row_number() OVER (PARTITION BY session_id ORDER BY min(msg_index), file_path) AS rank
    FROM a_tool GROUP BY session_id, file_path QUALIFY rank <= 15""",
)
def files_touched(t: Tables) -> DataFrame:
    return W.files_touched(t.a_tool)


@query(
    "tool_summary",
    f"""SELECT session_id, tool, count(*) AS calls, min(msg_index) AS first_msg, max(msg_index) AS last_msg,
      string_agg(left({INPUT}, 100), ' / ' ORDER BY n) FILTER (n <= 2) AS samples
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id, tool ORDER BY msg_index) AS n FROM a_tool) GROUP BY session_id, tool""",
)
def tool_summary(t: Tables) -> DataFrame:
    return W.tool_summary(t.a_tool).withColumn("samples", F.array_join("samples", " / "))


@query(
    "file_activity",
    """SELECT session_id, activity, file_path, first_seen, row_number() OVER w - 1 AS pos FROM (
      SELECT session_id, CASE tool WHEN 'Write' THEN 'created' WHEN 'Edit' THEN 'modified' ELSE 'read' END AS activity,
        file_path, min(msg_index) AS first_seen FROM a_tool WHERE tool IN ('Write', 'Edit', 'Read') GROUP BY ALL)
    WINDOW w AS (PARTITION BY session_id, activity ORDER BY first_seen, file_path) QUALIFY activity <> 'read' OR pos < 10""",
)
def file_activity(t: Tables) -> DataFrame:
    return W.file_activity(t.a_tool)


# --- chunks -----------------------------------------------------------------

CHUNKS_SQL = f"""
c AS (SELECT *, msg_index // {SIZE} AS chunk_no FROM a_call),
ct AS (SELECT session_id, chunk_no, tool, count(*) AS calls, row_number() OVER (PARTITION BY session_id, chunk_no ORDER BY count(*) DESC, tool) AS rk
  FROM c GROUP BY session_id, chunk_no, tool),
cts AS (SELECT session_id, chunk_no, string_agg(tool || '=' || calls, ',' ORDER BY rk) AS tools, max(tool) FILTER (rk = 1) AS top,
  max(calls) FILTER (rk = 1) AS n FROM ct GROUP BY ALL),
cf AS (SELECT session_id, chunk_no, file_path, min(msg_index) AS first_seen FROM c WHERE file_path <> '' GROUP BY ALL),
cfs AS (SELECT session_id, chunk_no, string_agg(file_path, ', ' ORDER BY first_seen, file_path) AS files, count(*) AS n_files,
  list(file_path ORDER BY first_seen, file_path) AS fl,
  count(*) FILTER (file_path LIKE '%.md') AS md, count(*) FILTER (file_path LIKE '%.ts') AS ts_files FROM cf GROUP BY ALL),
mo AS (SELECT session_id, msg_index AS pos, 0 AS kind, call_pos, CASE tool WHEN 'TodoWrite' THEN 'Progress update' ELSE 'Decision point' END AS what
    FROM a_call WHERE tool IN ('TodoWrite', 'AskUserQuestion')
  UNION ALL SELECT session_id, result_index, 1, call_pos, 'Error' FROM a_call WHERE is_error),
mos AS (SELECT session_id, pos // {SIZE} AS chunk_no, string_agg(what || ' at message ' || pos, ', ' ORDER BY pos, kind, call_pos) AS moments FROM mo GROUP BY ALL),
cm AS (SELECT session_id, msg_index // {SIZE} AS chunk_no, min(msg_index) AS first_msg, max(msg_index) AS last_msg FROM a_talk GROUP BY ALL),
chunks AS (SELECT session_id, chunk_no, first_msg, last_msg, coalesce(tools, '') AS tools, coalesce(files, '') AS files, coalesce(moments, '') AS moments, fl,
  coalesce(n_files, 0) AS n_files,
  CASE top WHEN 'Write' THEN 'Created ' || n || CASE WHEN n > 1 THEN ' files' ELSE ' file' END
    WHEN 'Edit' THEN 'Modified ' || n || CASE WHEN n > 1 THEN ' files' ELSE ' file' END
    WHEN 'Read' THEN 'Code exploration and discovery' WHEN 'TodoWrite' THEN 'Planning and task tracking'
    WHEN 'AskUserQuestion' THEN 'Decision making and clarification' WHEN 'Grep' THEN 'Grep operations'
    WHEN 'Bash' THEN CASE WHEN n > 5 THEN 'Running tests and build commands' ELSE 'Shell commands and git operations' END
    ELSE 'Discussion or exploration' END
  || CASE WHEN md > 0 THEN '; ' || md || CASE WHEN md > 1 THEN ' doc files' ELSE ' doc file' END ELSE '' END
  || CASE WHEN ts_files > 0 THEN '; ' || ts_files || CASE WHEN ts_files > 1 THEN ' code files' ELSE ' code file' END ELSE '' END AS label
  FROM cm LEFT JOIN cts USING (session_id, chunk_no) LEFT JOIN cfs USING (session_id, chunk_no) LEFT JOIN mos USING (session_id, chunk_no))"""


@query(
    "chunk_index",
    f"WITH {CHUNKS_SQL} SELECT session_id, chunk_no, first_msg, last_msg, tools, files, moments FROM chunks",
)
def chunk_index(t: Tables) -> DataFrame:
    pairs = F.transform("tools", lambda e: F.concat_ws("=", e["tool"], e["calls"]))
    return W.chunk_index(t.a_call, t.a_talk, SIZE).select(
        "session_id", "chunk_no", "first_msg", "last_msg", F.array_join(pairs, ",").alias("tools"),
        F.array_join("files", ", ").alias("files"), F.array_join("moments", ", ").alias("moments"),
    )


@query("chunk_labels", f"WITH {CHUNKS_SQL} SELECT session_id, chunk_no, label FROM chunks")
def chunk_labels(t: Tables) -> DataFrame:
    return W.chunk_index(t.a_call, t.a_talk, SIZE).select("session_id", "chunk_no", "label")


@query(
    "chunk_lines",
    f"""WITH {CHUNKS_SQL}, l AS (SELECT session_id, chunk_no, list_filter([
        (chunk_no + 1) || '. Messages ' || first_msg || '-' || last_msg, '   ' || label,
        CASE WHEN moments <> '' THEN '   Key moments: ' || moments END,
        CASE WHEN n_files > 0 THEN '   Files: ' || array_to_string(fl[1:5], ', ') END || CASE WHEN n_files > 5 THEN ' ... and ' || (n_files - 5) || ' more' ELSE '' END],
        lambda x: x IS NOT NULL) AS ls FROM chunks)
    SELECT session_id, chunk_no, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM l""",
)
def chunk_lines(t: Tables) -> DataFrame:
    return W.chunk_lines(W.chunk_index(t.a_call, t.a_talk, SIZE))


@query(
    "chunk_totals",
    f"""WITH c AS (SELECT *, msg_index // {SIZE} AS chunk_no FROM a_call),
    k AS (SELECT session_id, chunk_no, bool_or(tool = 'Write') AS w, bool_or(tool = 'Edit') AS e FROM c GROUP BY ALL),
    f AS (SELECT session_id, count(DISTINCT file_path) FILTER (w) AS files_created, count(DISTINCT file_path) FILTER (e) AS files_modified
      FROM c JOIN k USING (session_id, chunk_no) WHERE file_path <> '' GROUP BY session_id),
    n AS (SELECT session_id, count(*) AS calls FROM c GROUP BY session_id),
    b AS (SELECT session_id, max(msg_index) // {SIZE} + 1 AS chunks,
        floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 + 0.5)::BIGINT AS duration_minutes FROM a_talk GROUP BY session_id)
    SELECT session_id, coalesce(calls, 0) AS calls, chunks, duration_minutes, coalesce(files_created, 0) AS files_created,
      coalesce(files_modified, 0) AS files_modified FROM b LEFT JOIN n USING (session_id) LEFT JOIN f USING (session_id)""",
)
def chunk_totals(t: Tables) -> DataFrame:
    return W.chunk_totals(t.a_call, t.a_talk, SIZE)


# --- decisions, transitions, phases -----------------------------------------

TRANSITIONS_SQL = """
tr AS (SELECT session_id, msg_index, 0 AS kind, 'ExitPlanMode called' AS indicator FROM a_tool WHERE tool = 'TodoWrite' AND k % 5 = 0
  UNION ALL SELECT session_id, msg_index, 1, 'Error: ' || left(text, 100) FROM a_sig WHERE contains(lower(text), 'error') AND length(text) < 500)"""


def _transitions(t: Tables) -> DataFrame:
    exits = (F.col("tool") == "TodoWrite") & (F.col("k") % 5 == 0)
    calls = t.a_tool.withColumn("tool", F.when(exits, W.PLAN_TOOL).otherwise(F.col("tool")))
    return W.phase_transitions(calls, t.a_sig)


@query(
    "decision_points",
    "SELECT session_id, msg_index, tool, left(text, 200) AS snippet FROM a_sig WHERE tool IN ('TodoWrite', 'Write')",
)
def decision_points(t: Tables) -> DataFrame:
    return W.decision_points(t.a_sig, ["TodoWrite", "Write"])


@query("phase_transitions", f"WITH {TRANSITIONS_SQL} SELECT * FROM tr")
def phase_transitions(t: Tables) -> DataFrame:
    return _transitions(t)


RANGES_SQL = f"""{TRANSITIONS_SQL},
lens AS (SELECT session_id, max(msg_index) + 1 AS n FROM a_tool GROUP BY session_id),
ranges AS (SELECT session_id, row_number() OVER w AS phase_no, 'Phase ' || row_number() OVER w AS name,
  CASE WHEN row_number() OVER w = 1 THEN 1 ELSE msg_index END AS "start", coalesce(lead(msg_index) OVER w, n) AS "end", indicator
  FROM tr JOIN lens USING (session_id) WINDOW w AS (PARTITION BY session_id ORDER BY msg_index, kind))"""


def _ranges(t: Tables) -> DataFrame:
    lengths = t.a_tool.groupBy("session_id").agg((F.max("msg_index") + 1).alias("n"))
    return L.phase_ranges(_transitions(t), lengths)


@query("phase_ranges", f"WITH {RANGES_SQL} SELECT * FROM ranges")
def phase_ranges(t: Tables) -> DataFrame:
    return _ranges(t)


@query(
    "phase_rollup",
    f"""WITH {RANGES_SQL}, j AS (SELECT r.session_id, phase_no, tool, file_path
      FROM ranges r JOIN a_call t ON t.session_id = r.session_id AND msg_index BETWEEN "start" AND "end"),
    tc AS (SELECT session_id, phase_no, string_agg(tool || ': ' || n || 'x', ', ' ORDER BY n DESC, tool) AS tools_used
      FROM (SELECT session_id, phase_no, tool, count(*) AS n FROM j GROUP BY ALL) GROUP BY ALL),
    fc AS (SELECT session_id, phase_no, count(DISTINCT file_path) FILTER (tool = 'Write') AS files_created,
      count(DISTINCT file_path) FILTER (tool = 'Edit') AS files_modified FROM j WHERE file_path <> '' GROUP BY ALL),
    mc AS (SELECT r.session_id, phase_no, count(*) AS message_count, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 + 0.5)::BIGINT AS duration_minutes
      FROM ranges r JOIN a_talk t ON t.session_id = r.session_id AND msg_index BETWEEN "start" AND "end" GROUP BY ALL)
    SELECT session_id, phase_no, name, "start", "end", coalesce(message_count, 0) AS message_count, duration_minutes,
      coalesce(files_created, 0) AS files_created, coalesce(files_modified, 0) AS files_modified, coalesce(tools_used, '') AS tools_used
    FROM ranges LEFT JOIN mc USING (session_id, phase_no) LEFT JOIN tc USING (session_id, phase_no) LEFT JOIN fc USING (session_id, phase_no)""",
)
def phase_rollup(t: Tables) -> DataFrame:
    return W.phase_rollup(t.a_call, t.a_talk, _ranges(t))


ANGLE_SQL = f"""WITH {TRANSITIONS_SQL},
cl AS (SELECT session_id, count(*) FILTER (tool = 'Edit') AS edits, count(*) FILTER (tool = 'Bash') AS bash,
  count(*) FILTER (tool = 'TodoWrite') AS todos, count(*) FILTER (tool = 'AskUserQuestion') AS questions, count(*) FILTER (tool = 'Read') AS reads,
  count(*) FILTER (tool = 'Grep') AS greps, count(DISTINCT CASE WHEN tool = 'Write' THEN file_path END) AS created FROM a_call GROUP BY session_id),
tk AS (SELECT session_id, count(*) AS messages, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 + 0.5)::BIGINT AS minutes FROM a_talk GROUP BY session_id),
f AS (SELECT session_id, messages, minutes, coalesce(edits, 0) AS edits, coalesce(bash, 0) AS bash, coalesce(todos, 0) AS todos, coalesce(questions, 0) AS questions,
  coalesce(reads, 0) AS reads, coalesce(greps, 0) AS greps, coalesce(created, 0) AS created,
  session_id IN (SELECT session_id FROM tr WHERE contains(lower(indicator), 'error')) AS has_errors FROM tk LEFT JOIN cl USING (session_id))
SELECT session_id, messages, created, has_errors, CASE WHEN messages < 20 AND created > 5 THEN 'one-shot-success'
  WHEN edits > 10 OR (bash > 8 AND has_errors) THEN 'debugging-struggle'
  WHEN created / messages > 0.15 AND minutes < 45 THEN 'speed-efficiency'
  WHEN todos > 5 OR questions > 3 THEN 'workflow-patterns' WHEN reads > 15 OR greps > 10 THEN 'learning-new-tech' ELSE 'workflow-patterns' END AS angle,
  CASE WHEN messages < 20 AND created > 5 THEN 'The initial request and how clear it was'
  WHEN edits > 10 OR (bash > 8 AND has_errors) THEN 'What went wrong and why'
  WHEN created / messages > 0.15 AND minutes < 45 THEN 'What enabled the fast implementation'
  WHEN todos > 5 OR questions > 3 THEN 'Your planning and task management approach' WHEN reads > 15 OR greps > 10 THEN 'What you were trying to learn'
  ELSE 'Your planning and task management approach' END AS first_focus
FROM f"""


@query("session_angle", ANGLE_SQL)
def session_angle(t: Tables) -> DataFrame:
    out = W.session_angle(W.session_facts(t.a_call, t.a_talk, _transitions(t)))
    return out.select("session_id", "messages", "created", "has_errors", "angle", F.col("focus")[0].alias("first_focus"))


@query(
    "session_overview",
    """SELECT session_id, count(*) AS invocations, count(DISTINCT tool) AS distinct_tools, count(DISTINCT file_path) AS distinct_files,
      count(*) AS turns, count(*) FILTER (tool IN ('Read', 'TodoWrite')) AS user_messages FROM a_tool GROUP BY session_id""",
)
def session_overview(t: Tables) -> DataFrame:
    return W.session_overview(t.a_tool, t.a_sig)


# --- artifacts --------------------------------------------------------------


def _entries(t: Tables) -> DataFrame:
    """Tool log as parsed transcript entries."""
    k, tool = F.col("k"), F.col("tool")
    ks = k.cast("string")
    code = F.expr("repeat(concat(props, '\\n'), k)")

    def use(name: str, **fields) -> Column:
        inner = F.struct(*[v.alias(n) for n, v in fields.items()])
        return F.to_json(F.struct(F.lit("tool_use").alias("type"), F.lit(name).alias("name"), inner.alias("input")))

    def result(content, error: bool) -> Column:
        return F.to_json(
            F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), ks).alias("tool_use_id"),
                     F.lit(error).alias("is_error"), content.alias("content"))
        )

    said = F.to_json(
        F.struct(F.lit("text").alias("type"),
                 F.concat(F.lit("I am working on step "), ks, F.lit(" of the long plan we agreed on.")).alias("text"))
    )
    even = k % 2 == 0
    block = (
        F.when(tool == "Write", use("Write", file_path=F.col("file_path"), content=code))
        .when(tool == "Edit", use("Edit", file_path=F.col("file_path"), new_string=code))
        .when((tool == "Bash") & even, result(F.concat(F.lit("failure "), code), True))
        .when(tool == "Bash", use("Bash", command=F.concat(F.lit("git status && npm test "), ks)))
        .when(tool == "Read", result(code, False))
        .when(~even, said)
    )
    user = (tool == "Read") | ((tool == "Bash") & even) | ((tool == "TodoWrite") & even)
    plain = F.when((tool == "TodoWrite") & even, F.concat(F.lit("please go on with step "), ks))
    return t.a_tool.select(
        "session_id", "msg_index", F.when(user, "user").otherwise("assistant").alias("type"), plain.alias("plain"),
        F.when(plain.isNull(), C.blocks_of(F.array(block))).alias("blocks"),
    )


def _cut(x: str, n: int) -> str:
    head = f"left({x}, {n})"
    kept = f"CASE WHEN contains({head}, chr(10)) THEN {n} - 1 - length(regexp_extract({head}, '([^\\n]*)$', 1)) ELSE -1 END"
    return (
        f"CASE WHEN length({x}) <= {n} THEN {x} WHEN {kept} > {n} * 0.8 THEN left({head}, {kept}) || chr(10) || '... [truncated]' "
        f"ELSE {head} || '... [truncated]' END"
    )


ARTIFACTS_SQL = f"""
src AS (SELECT *, repeat(props || chr(10), k) AS code, 'failure ' || repeat(props || chr(10), k) AS failure FROM a_tool),
arts AS (SELECT session_id, msg_index, 0 AS block_no,
  CASE WHEN tool IN ('Write', 'Edit') THEN 'code' WHEN tool = 'Bash' THEN CASE WHEN k % 2 = 0 THEN 'error' ELSE 'command' END
    WHEN tool = 'Read' THEN 'output' ELSE 'quote' END AS type,
  CASE WHEN tool IN ('Write', 'Edit') THEN {_cut('code', 300)}
    WHEN tool = 'Bash' AND k % 2 = 0 THEN {_cut('failure', 300)}
    WHEN tool = 'Bash' THEN 'git status && npm test ' || k WHEN tool = 'Read' THEN {_cut('code', 300)}
    WHEN k % 2 = 0 THEN 'please go on with step ' || k ELSE 'I am working on step ' || k || ' of the long plan we agreed on.' END AS content,
  CASE WHEN tool = 'Write' THEN 'Created ' || file_path WHEN tool = 'Edit' THEN 'Modified ' || file_path
    WHEN tool = 'Bash' THEN CASE WHEN k % 2 = 0 THEN 'Error from tool t' || k ELSE 'Shell command' END
    WHEN tool = 'Read' THEN 'Command output' WHEN k % 2 = 0 THEN 'User request' ELSE 'Assistant explanation' END AS context,
  CASE WHEN tool IN ('Write', 'Edit') THEN file_path ELSE '' END AS file_path,
  CASE WHEN tool IN ('Write', 'Edit') THEN tool WHEN tool = 'Bash' AND k % 2 = 1 THEN 'Bash' WHEN tool = 'TodoWrite' AND k % 2 = 1 THEN 'text' ELSE '' END AS tool_name
  FROM src WHERE CASE WHEN tool IN ('Write', 'Edit') THEN k > 0 WHEN tool = 'Read' THEN length(code) BETWEEN 11 AND 999 ELSE true END)"""
SCORED_SQL = f"""{ARTIFACTS_SQL},
scored AS (SELECT *, round(least(length(content) / 100.0::DOUBLE, 10.0) + CASE type WHEN 'code' THEN 10 + CASE WHEN tool_name = 'Write' THEN 5 ELSE 0 END
    + CASE WHEN file_path LIKE '%.ts' THEN 3 WHEN file_path LIKE '%.md' THEN 2 ELSE 0 END
  WHEN 'error' THEN 15 WHEN 'command' THEN 13 WHEN 'quote' THEN 3 ELSE 0 END, 6) AS score FROM arts)"""

ALL_TYPES = ["code", "error", "quote", "command", "output"]


def _artifacts(t: Tables) -> DataFrame:
    return A.extract_artifacts(A.explode_blocks(_entries(t)), ALL_TYPES, 300)


@query("artifacts", f"WITH {ARTIFACTS_SQL} SELECT * FROM arts")
def artifacts(t: Tables) -> DataFrame:
    return _artifacts(t)


@query("artifact_scores", f"WITH {SCORED_SQL} SELECT session_id, msg_index, block_no, type, score FROM scored")
def artifact_scores(t: Tables) -> DataFrame:
    return A.score_artifacts(_artifacts(t)).select("session_id", "msg_index", "block_no", "type", "score")


@query(
    "top_artifacts",
    f"""WITH {SCORED_SQL} SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, msg_index, block_no) AS rank
    FROM scored QUALIFY rank <= 20""",
)
def top_artifacts(t: Tables) -> DataFrame:
    return A.top_artifacts(A.score_artifacts(_artifacts(t)))


@query(
    "phase_artifacts",
    f"""WITH {RANGES_SQL}, {ARTIFACTS_SQL}
    SELECT r.session_id, phase_no, name, msg_index, type, row_number() OVER (PARTITION BY r.session_id, phase_no ORDER BY msg_index, block_no) AS rank
    FROM ranges r JOIN arts a ON a.session_id = r.session_id AND msg_index BETWEEN "start" AND "end" QUALIFY rank <= 10""",
)
def phase_artifacts(t: Tables) -> DataFrame:
    out = A.phase_artifacts(_artifacts(t), _ranges(t))
    return out.select("session_id", "phase_no", "name", "msg_index", "type", "rank")


@query(
    "code_snippets",
    """WITH src AS (SELECT *, repeat(props || chr(10), k) AS code FROM a_tool),
    s AS (SELECT session_id, msg_index, CASE WHEN tool = 'Bash' THEN 'failure ' || code ELSE code END AS code,
      CASE WHEN tool IN ('Bash', 'Read') THEN 'text' WHEN k % 4 = 0 THEN 'typescript' WHEN k % 4 = 1 THEN 'markdown' WHEN k % 4 = 2 THEN 'json' ELSE 'python' END AS language,
      CASE tool WHEN 'Write' THEN 'Writing ' || file_path WHEN 'Edit' THEN 'Editing ' || file_path ELSE 'Result from tool' END AS context,
      CASE WHEN tool IN ('Write', 'Edit') THEN tool ELSE 'tool_result' END AS tool_name
      FROM src WHERE tool IN ('Write', 'Edit') AND k > 0 OR tool = 'Read' OR tool = 'Bash' AND k % 2 = 0)
    SELECT session_id, msg_index, row_number() OVER (PARTITION BY session_id ORDER BY msg_index) AS rank, code, language, context, tool_name
    FROM s WHERE tool_name <> 'tool_result' OR length(code) BETWEEN 51 AND 1999 QUALIFY rank <= 9""",
)
def code_snippets(t: Tables) -> DataFrame:
    return A.code_snippets(A.explode_blocks(_entries(t)))
