"""Tool-call statistics, chunk indexes and rule labels.

Input is a call log `session_id, msg_index, tool, file_path, ...`, one row per call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.content import DECISION_TOOL
from skein.operators.ordered import chunk_of, ordinal, top_k
from skein.session import materialise

# Caps of tool and file reports.
FILES_CAP, READ_CAP, TOP_TOOLS = 15, 10, 6
SAMPLES, SAMPLE_CHARS = 2, 100
CHUNK_MESSAGES = 50
SNIPPET, INDICATOR, ERROR_TEXT_LIMIT = 200, 100, 500
BASH_SPLIT = 5

# Tools that mark decisions, and the label of a chunk by its dominant tool.
DECISION_TOOLS = ("AskUserQuestion", "ExitPlanMode", "Task")
PLAN_TOOL = "ExitPlanMode"
PLAN_INDICATOR = "ExitPlanMode called"
MOMENTS = {
    "AskUserQuestion": "Decision point at message ",
    "ExitPlanMode": "Phase transition at message ",
    "TodoWrite": "Progress update at message ",
}
ERROR_MOMENT = "Error at message "
CHUNK_LABELS = {
    "Read": "Code exploration and discovery",
    "Glob": "Code exploration and discovery",
    "TodoWrite": "Planning and task tracking",
    "ExitPlanMode": "Planning phase completion",
    "AskUserQuestion": "Decision making and clarification",
    "Task": "Delegated analysis",
}
BASH_MANY = "Running tests and build commands"
BASH_FEW = "Shell commands and git operations"
NO_TOOLS = "Discussion or exploration"

# Thresholds and names of the session angles, in order, and their focus areas.
ONE_SHOT_MESSAGES, ONE_SHOT_FILES = 20, 5
DEBUG_EDITS, DEBUG_BASH = 10, 8
SPEED_RATIO, SPEED_MINUTES = 0.15, 45
FLOW_TODOS, FLOW_QUESTIONS = 5, 3
LEARN_READS, LEARN_GREPS, LEARN_SEARCHES = 15, 10, 2
ANGLES = ("one-shot-success", "debugging-struggle", "speed-efficiency", "workflow-patterns", "learning-new-tech")
FOCUS = {
    "one-shot-success": [
        "The initial request and how clear it was",
        "What Claude Code understood immediately",
        "The final result quality",
    ],
    "debugging-struggle": [
        "What went wrong and why",
        "How you and Claude Code debugged together",
        "What you learned from the struggle",
    ],
    "workflow-patterns": [
        "Your planning and task management approach",
        "How you structured the conversation",
        "Reusable techniques you discovered",
    ],
    "speed-efficiency": [
        "What enabled the fast implementation",
        "Tools and shortcuts used",
        "Final output and time saved",
    ],
    "learning-new-tech": [
        "What you were trying to learn",
        "How Claude Code helped you explore",
        "Key concepts you discovered",
    ],
    "custom": ["User-defined focus"],
}


def tool_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id", "tool").agg(F.count("*").alias("calls"))


def tool_map(calls: DataFrame) -> DataFrame:
    """Totals as a map per session; one entry per distinct tool."""
    return tool_totals(calls).groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "calls")))).alias("totals")
    )


def top_tools(calls: DataFrame, n: int = TOP_TOOLS) -> DataFrame:
    return top_k(tool_totals(calls), ["session_id"], [F.desc("calls"), F.col("tool")], n, "rank")


def files_touched(calls: DataFrame, cap: int = FILES_CAP) -> DataFrame:
    """First distinct files of a session in first-seen order."""
    seen = calls.filter("file_path <> ''").groupBy("session_id", "file_path").agg(
        F.min("msg_index").alias("first_seen")
    )
    return top_k(seen, ["session_id"], [F.col("first_seen"), F.col("file_path")], cap, "rank")


def tool_summary(calls: DataFrame, samples: int = SAMPLES, chars: int = SAMPLE_CHARS) -> DataFrame:
    """Count, first and last message and the first inputs of each tool."""
    keys = ["session_id", "tool"]
    base = calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.min("msg_index").alias("first_msg"), F.max("msg_index").alias("last_msg")
    )
    firsts = top_k(calls.filter("input is not null"), keys, [F.col("msg_index")], samples, "_n").groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_n", F.left("input", F.lit(chars)).alias("s")))), lambda x: x["s"]
        ).alias("samples")
    )
    return base.join(firsts, keys, "left")


def file_activity(calls: DataFrame, read_cap: int = READ_CAP) -> DataFrame:
    """Created, modified and read files in first-seen order, one row per file.

    Only the read list is capped; the others stay whole, so their positions
    come from the bucketed ordinal.
    """
    kind = F.create_map(
        F.lit("Write"), F.lit("created"), F.lit("Edit"), F.lit("modified"), F.lit("Read"), F.lit("read")
    )
    seen = (
        calls.filter(F.col("tool").isin("Write", "Edit", "Read") & (F.col("file_path") != ""))
        .groupBy("session_id", F.element_at(kind, F.col("tool")).alias("activity"), "file_path")
        .agg(F.min("msg_index").alias("first_seen"))
    )
    placed = ordinal(
        seen, ["session_id", "activity"], ["first_seen", "file_path"], chunk_of("first_seen"), "pos"
    )
    return placed.filter((F.col("activity") != "read") | (F.col("pos") < read_cap))


# --- chunks -----------------------------------------------------------------


def _chunk(size: int) -> Column:
    return F.floor(F.col("msg_index") / size).alias("chunk_no")


def chunk_tools(calls: DataFrame, size: int = CHUNK_MESSAGES) -> DataFrame:
    return calls.groupBy("session_id", _chunk(size), "tool").agg(F.count("*").alias("calls"))


def chunk_files(calls: DataFrame, size: int = CHUNK_MESSAGES) -> DataFrame:
    return (
        calls.filter("file_path <> ''")
        .groupBy("session_id", _chunk(size), "file_path")
        .agg(F.min("msg_index").alias("first_seen"))
    )


def moments(calls: DataFrame) -> DataFrame:
    """Key moments `session_id, msg_index, call_pos, kind, moment`.

    A call of a marked tool is one, and so is a failing result, at the message
    of the result (`result_index`); a call may have both.
    """
    table = F.create_map(*[F.lit(x) for kv in MOMENTS.items() for x in kv])
    own = F.struct(F.col("msg_index").alias("at"), F.lit(0).alias("kind"), F.element_at(table, F.col("tool")).alias("text"))
    failed = F.struct(
        F.col("result_index").alias("at"), F.lit(1).alias("kind"), F.when(F.col("is_error"), F.lit(ERROR_MOMENT)).alias("text")
    )
    both = F.filter(F.array(own, failed), lambda m: m["text"].isNotNull())
    return calls.select("session_id", "call_pos", F.explode(both).alias("m")).select(
        "session_id", F.col("m.at").alias("msg_index"), "call_pos", F.col("m.kind").alias("kind"),
        F.concat("m.text", F.col("m.at").cast("string")).alias("moment"),
    )


def chunk_index(calls: DataFrame, messages: DataFrame, size: int = CHUNK_MESSAGES) -> DataFrame:
    """One row per chunk of messages: range, tool counts, files, key moments, label.

    Chunks come from all messages, whether they call a tool or not. A chunk
    holds `size` messages, so the lists of one chunk are bounded.
    """
    keys = ["session_id", "chunk_no"]
    tools = chunk_tools(calls, size).groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("calls")).alias("n"), "tool"))
        ).alias("_tools")
    )
    files = chunk_files(calls, size).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("first_seen", "file_path"))).alias("_files")
    )
    marked = moments(calls).groupBy("session_id", _chunk(size)).agg(
        F.array_sort(F.collect_list(F.struct("msg_index", "kind", "call_pos", "moment"))).alias("_moments")
    )
    base = messages.groupBy("session_id", _chunk(size)).agg(
        F.min("msg_index").alias("first_msg"), F.max("msg_index").alias("last_msg")
    )
    rows = base.join(tools, keys, "left").join(files, keys, "left").join(marked, keys, "left")

    def listed(col: str, item, kind: str) -> Column:
        return F.coalesce(F.transform(col, item), F.array().cast(f"array<{kind}>"))

    return rows.select(
        *keys, "first_msg", "last_msg",
        listed(
            "_tools", lambda x: F.struct(x["tool"].alias("tool"), (-x["n"]).alias("calls")), "struct<tool:string,calls:bigint>"
        ).alias("tools"),
        listed("_files", lambda x: x["file_path"], "string").alias("files"),
        listed("_moments", lambda x: x["moment"], "string").alias("moments"),
    ).withColumn("label", chunk_label(F.col("tools"), F.col("files")))


def chunk_label(tools: Column, files: Column) -> Column:
    """Label from the dominant tool (count, then name) and the kinds of files."""
    top = F.try_element_at(tools, F.lit(1))
    name, n = top["tool"], top["calls"]

    def made(verb: str) -> Column:
        return F.concat(F.lit(verb + " "), X.count_label(n, "file"))

    table = F.create_map(*[F.lit(x) for kv in CHUNK_LABELS.items() for x in kv])
    main = (
        F.when(name == "Write", made("Created"))
        .when(name == "Edit", made("Modified"))
        .when(name == "Bash", F.when(n > BASH_SPLIT, F.lit(BASH_MANY)).otherwise(F.lit(BASH_FEW)))
        .otherwise(F.coalesce(F.try_element_at(table, name), F.concat(name, F.lit(" operations"))))
    )

    def kind(pattern: str, word: str) -> Column:
        k = F.size(F.filter(F.coalesce(files, F.array().cast("array<string>")), lambda f: f.rlike(pattern)))
        return F.when(k > 0, X.count_label(k, f"{word} file"))

    parts = F.concat_ws(
        "; ", main, kind(r"\.md$", "doc"), kind(r"\.(ts|js|tsx|jsx)$", "code"),
        kind(r"package\.json|tsconfig|\.eslintrc|\.prettier", "config"),
    )
    return F.when(F.coalesce(F.size(tools), F.lit(0)) < 1, F.lit(NO_TOOLS)).otherwise(parts)


def chunk_totals(calls: DataFrame, messages: DataFrame, size: int = CHUNK_MESSAGES) -> DataFrame:
    """Session totals, chunks and minutes from all messages; a file counts as created (modified) when its chunk has any Write (Edit)."""
    keys = ["session_id", "chunk_no"]
    kinds = calls.groupBy("session_id", _chunk(size)).agg(
        F.max(F.col("tool") == "Write").alias("_writes"), F.max(F.col("tool") == "Edit").alias("_edits")
    )
    files = chunk_files(calls, size).join(kinds, keys)
    # two steps keep a hot session spread over its files
    per_file = files.groupBy("session_id", "file_path").agg(
        F.max("_writes").alias("_w"), F.max("_edits").alias("_e")
    )
    counted = per_file.groupBy("session_id").agg(
        F.count_if("_w").alias("files_created"), F.count_if("_e").alias("files_modified")
    )
    called = calls.groupBy("session_id").agg(F.count("*").alias("calls"))
    base = messages.groupBy("session_id").agg(
        F.max(F.floor(F.col("msg_index") / size) + 1).alias("chunks"),
        X.rounded_minutes(F.min("ts"), F.max("ts")).alias("duration_minutes"),
    )
    out = base.join(called, "session_id", "left").join(counted, "session_id", "left")
    return out.fillna(0, ["calls", "files_created", "files_modified"])


def chunk_lines(chunks: DataFrame, preview: int = 5) -> DataFrame:
    """Chunk index as ordered text lines."""
    more = F.size("files") - preview
    files = F.array_join(F.slice("files", 1, preview), ", ")
    line = F.array_compact(
        F.array(
            F.concat(
                (F.col("chunk_no") + 1).cast("string"), F.lit(". Messages "), F.col("first_msg").cast("string"),
                F.lit("-"), F.col("last_msg").cast("string"),
            ),
            F.concat(F.lit("   "), "label"),
            F.when(F.size("moments") > 0, F.concat(F.lit("   Key moments: "), F.array_join("moments", ", "))),
            F.when(
                F.size("files") > 0,
                F.concat(
                    F.lit("   Files: "), files,
                    F.when(more > 0, F.concat(F.lit(" ... and "), more.cast("string"), F.lit(" more"))).otherwise(""),
                ),
            ),
        )
    )
    return chunks.select("session_id", "chunk_no", F.posexplode(line).alias("line_no", "line"))


# --- decisions, transitions, angle ------------------------------------------


def decision_points(calls: DataFrame, tools: Sequence[str] = DECISION_TOOLS) -> DataFrame:
    """Calls of decision tools with the text said around them. Needs a `text` column."""
    return calls.filter(F.col("tool").isin(list(tools))).select(
        "session_id", "msg_index", "tool", F.left("text", F.lit(SNIPPET)).alias("snippet")
    )


def phase_transitions(
    calls: DataFrame, texts: DataFrame, plan_tool: str = PLAN_TOOL, word: str = "error"
) -> DataFrame:
    """Plan exits and short texts that mention an error.

    `kind` 0 sorts a plan exit before an error of the same message.
    """
    plans = calls.filter(F.col("tool") == plan_tool).select(
        "session_id", "msg_index", F.lit(0).alias("kind"), F.lit(PLAN_INDICATOR).alias("indicator")
    )
    short = texts.filter(F.contains(F.lower("text"), F.lit(word)) & (F.length("text") < ERROR_TEXT_LIMIT))
    errors = short.select(
        "session_id", "msg_index", F.lit(1).alias("kind"),
        F.concat(F.lit("Error: "), F.left("text", F.lit(INDICATOR))).alias("indicator"),
    )
    return plans.unionByName(errors)


def session_facts(calls: DataFrame, messages: DataFrame, transitions: DataFrame) -> DataFrame:
    """The counts that decide the angle; messages and minutes cover sessions without a call too."""

    def n(tool: str) -> Column:
        return F.count_if(F.col("tool") == tool)

    talked = messages.groupBy("session_id").agg(
        F.count("*").alias("messages"), X.rounded_minutes(F.min("ts"), F.max("ts")).alias("minutes")
    )
    called = calls.groupBy("session_id").agg(
        n("Edit").alias("edits"), n("Bash").alias("bash"), n("TodoWrite").alias("todos"),
        n(DECISION_TOOL).alias("questions"), n("Read").alias("reads"), n("Grep").alias("greps"),
        n("WebSearch").alias("searches"),
        F.count_distinct(F.when(F.col("tool") == "Write", F.col("file_path"))).alias("created"),
    )
    counts = [c for c in called.columns if c != "session_id"]
    base = talked.join(called, "session_id", "left").fillna(0, counts)
    failing = transitions.filter(F.contains(F.lower("indicator"), F.lit("error"))).select("session_id").distinct()
    return base.join(failing.withColumn("_err", F.lit(True)), "session_id", "left").withColumn(
        "has_errors", F.coalesce("_err", F.lit(False))
    ).drop("_err")


def session_angle(facts: DataFrame) -> DataFrame:
    """First matching story angle of a session and its focus areas."""
    c = F.col
    one_shot, debugging, speed, flow, learn = ANGLES
    angle = (
        F.when((c("messages") < ONE_SHOT_MESSAGES) & (c("created") > ONE_SHOT_FILES), one_shot)
        .when((c("edits") > DEBUG_EDITS) | ((c("bash") > DEBUG_BASH) & c("has_errors")), debugging)
        .when((c("created") / c("messages") > SPEED_RATIO) & (c("minutes") < SPEED_MINUTES), speed)
        .when((c("todos") > FLOW_TODOS) | (c("questions") > FLOW_QUESTIONS), flow)
        .when(
            (c("reads") > LEARN_READS) | (c("greps") > LEARN_GREPS) | (c("searches") > LEARN_SEARCHES), learn
        )
        .otherwise(flow)
    )
    areas = F.create_map(*[x for k, v in FOCUS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    return facts.withColumn("angle", angle).withColumn("focus", F.element_at(areas, F.col("angle")))


def session_overview(calls: DataFrame, roles: DataFrame) -> DataFrame:
    """Narrative counts: turns, invocations, distinct tools and files, user messages."""
    c = calls.groupBy("session_id").agg(
        F.count("*").alias("invocations"), F.count_distinct("tool").alias("distinct_tools"),
        F.count_distinct(F.when(F.col("file_path") != "", F.col("file_path"))).alias("distinct_files"),
    )
    r = roles.groupBy("session_id").agg(
        F.count_if(F.col("role").isin("user", "assistant")).alias("turns"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
    )
    return r.join(c, "session_id", "left").fillna(0)


def phase_rollup(calls: DataFrame, messages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Messages, minutes, tool calls and files of every phase range, whether a tool was called in it or not.

    Each range is cut at the chunk grid so that rows meet it on (session, chunk).
    """
    keys = ["session_id", "phase_no"]
    # three joins read the ranges, so the events are numbered and cut into them once
    ranges = materialise(ranges, "phase-ranges")
    # two roll-ups read the joined calls, so that join runs once
    joined = materialise(in_ranges(calls, ranges).select(*keys, "tool", "file_path"), "phases")
    per_file = joined.filter("file_path <> ''").groupBy(*keys, "file_path").agg(
        F.max(F.col("tool") == "Write").alias("_w"), F.max(F.col("tool") == "Edit").alias("_e")
    )
    files = per_file.groupBy(*keys).agg(
        F.count_if("_w").alias("files_created"), F.count_if("_e").alias("files_modified")
    )
    talked = in_ranges(messages, ranges).groupBy(*keys).agg(
        F.count("*").alias("message_count"), X.rounded_minutes(F.min("ts"), F.max("ts")).alias("duration_minutes")
    )
    base = ranges.select(*keys, "name", "start", "end").join(talked, keys, "left")
    tools = joined.groupBy(*keys, "tool").agg(F.count("*").alias("calls")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("n"), "tool"))).alias("_t")
    )
    label = F.transform("_t", lambda x: F.concat(x["tool"], F.lit(": "), (-x["n"]).cast("string"), F.lit("x")))
    out = base.join(files, keys, "left").join(tools, keys, "left").select(
        *base.columns, "files_created", "files_modified", F.coalesce(F.array_join(label, ", "), F.lit("")).alias("tools_used")
    )
    return out.fillna(0, ["message_count", "files_created", "files_modified"])


def in_ranges(rows: DataFrame, ranges: DataFrame, size: int = 256) -> DataFrame:
    """Rows whose `msg_index` lies in an inclusive `[start, end]` of their session.

    An equi-join on (session, chunk) with a residual check; no broadcast of a
    table that grows, and a long session spreads over its chunks.
    """
    cut = ranges.withColumn(
        "_chunk", F.explode(F.sequence(chunk_of("start", size), chunk_of(F.greatest("start", "end"), size)))
    )
    return (
        rows.withColumn("_chunk", chunk_of("msg_index", size))
        .join(cut, ["session_id", "_chunk"])
        .filter(F.col("msg_index").between(F.col("start"), F.col("end")))
        .drop("_chunk")
    )
