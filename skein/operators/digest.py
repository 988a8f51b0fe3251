"""Digests over many sessions and over single sessions, as tables and as text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import signals as G
from skein.operators import timeline as L
from skein.operators import tools as W
from skein.operators.ordered import last_before, top_k

# Caps of the cross-session digest.
PROMPTS, DECISIONS = 5, 3
NOTABLE_MIN, TEXT_CAP, LINE_CAP, FIRST_PROMPT_CAP = 30, 400, 240, 160

# Caps of the review lines by use: tools, created, modified, decisions, transitions (None keeps all).
REVIEW_CAPS = {
    "meta-analysis": (None, 15, 10, None, 10),
    "approach": (12, 20, 0, 5, None),
    "problems": (10, 0, 15, 5, None),
    "successes": (10, 15, 0, 3, None),
}


def top_prompts(messages: DataFrame, n: int = PROMPTS) -> DataFrame:
    """Longest typed prompts of a session; message 0 is skipped as injected context."""
    notable = messages.filter((F.length("user_text") > NOTABLE_MIN) & (F.col("msg_index") > 0))
    ranked = top_k(notable, ["session_id"], [F.desc(F.length("user_text")), F.col("msg_index")], n, "rank")
    return ranked.select(
        "session_id", "rank", "msg_index", "ts", X.cut_with_ellipsis("user_text", TEXT_CAP).alias("text")
    )


def top_decisions(
    messages: DataFrame, n: int = DECISIONS, cues: Sequence[str] = G.DECISION_CUES
) -> DataFrame:
    """Longest assistant texts that announce a choice."""
    said = messages.filter(G.decides(F.col("assistant_text"), cues))
    ranked = top_k(said, ["session_id"], [F.desc(F.length("assistant_text")), F.col("msg_index")], n, "rank")
    return ranked.select(
        "session_id", "rank", "msg_index", "ts", X.cut_with_ellipsis("assistant_text", TEXT_CAP).alias("text")
    )


def _packed(ranked: DataFrame, name: str) -> DataFrame:
    """At most the top k rows per session as one ordered array."""
    return ranked.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "msg_index", "ts", "text"))).alias(name)
    )


def window_digest(
    sessions: DataFrame,
    messages: DataFrame,
    calls: DataFrame,
    cues: Sequence[str] = G.DECISION_CUES,
) -> DataFrame:
    """One nested row per chosen session: prompts, decisions, tool totals, first files.

    `sessions` is the window already chosen (`window_sessions`); messages and
    calls are reduced to it by a semi-join before any ranking.
    """
    ids = sessions.select("session_id")
    msgs = messages.join(ids, "session_id", "left_semi")
    used = calls.join(ids, "session_id", "left_semi")
    files = W.files_touched(used).groupBy("session_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "file_path"))), lambda f: f["file_path"]
        ).alias("files_touched")
    )
    ranked = W.tool_totals(used).groupBy("session_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("n"), "tool"))),
            lambda x: F.struct(x["tool"].alias("tool"), (-x["n"]).alias("calls")),
        ).alias("tools")
    )
    return (
        sessions.join(_packed(top_prompts(msgs), "user_prompts"), "session_id", "left")
        .join(_packed(top_decisions(msgs, cues=cues), "assistant_decisions"), "session_id", "left")
        .join(ranked, "session_id", "left")
        .join(files, "session_id", "left")
    )


def _cited(items: str) -> Column:
    line = lambda p: F.concat(
        F.lit("- "), X.citation("session_id", p["msg_index"]), F.lit(" "),
        X.cut_with_ellipsis(X.collapse(p["text"]), LINE_CAP),
    )
    return F.transform(items, line)


def digest_lines(digest: DataFrame) -> DataFrame:
    """Digest as `session_id, section, pos, line`; sections are numbered in reading order."""
    sid = F.left("session_id", F.lit(8))
    head = F.concat(
        F.lit("## ["), sid, F.lit("] "), "project", F.lit("   ("),
        F.coalesce(F.date_format("last_msg_at", "yyyy-MM-dd HH:mm"), F.lit("?")), F.lit(", "),
        F.col("msg_count").cast("string"), F.lit(" msgs, source="), "source", F.lit(")"),
    )
    tools = F.transform(
        F.slice("tools", 1, W.TOP_TOOLS), lambda x: F.concat(x["tool"], F.lit("×"), x["calls"].cast("string"))
    )
    none = F.array().cast("array<string>")

    def block(cond: Column, lines: Column) -> Column:
        return F.when(cond, lines).otherwise(none)

    some = lambda name: F.coalesce(F.size(name), F.lit(0)) > 0
    sections = F.array(
        F.array(F.lit("---"), head),
        block(
            F.coalesce(F.col("first_user_prompt") != "", F.lit(False)),
            F.array(F.concat(F.lit("First prompt: "), X.cut_with_ellipsis("first_user_prompt", FIRST_PROMPT_CAP))),
        ),
        block(some("user_prompts"), F.concat(F.array(F.lit("### Notable user prompts")), _cited("user_prompts"))),
        block(
            some("assistant_decisions"),
            F.concat(F.array(F.lit("### Assistant decisions / pivots")), _cited("assistant_decisions")),
        ),
        block(some("tools"), F.array(F.concat(F.lit("### Tool signature: "), F.array_join(tools, ", ")))),
        block(
            some("files_touched"), F.array(F.concat(F.lit("### Files touched: "), F.array_join("files_touched", ", ")))
        ),
    )
    per_section = digest.select("session_id", F.posexplode(sections).alias("section", "lines"))
    return per_section.select("session_id", "section", F.posexplode("lines").alias("pos", "line"))


def prior_windows(windows: DataFrame) -> DataFrame:
    """For each window the latest one that ended before it starts.

    `windows(name, start, end)`. Distinct ends and starts become one stream of
    instants, along which `last_before` finds the latest end. No window is
    paired with all others, and neither many windows in one instant nor a wide
    spread of times makes a task larger than others. A window without a start
    has no prior one; one without an end is nobody's prior.
    """
    done = F.struct(F.col("end"), F.col("name"))
    ends = windows.filter(F.col("end").isNotNull()).groupBy(F.col("end").alias("at"))
    ends = ends.agg(F.max(done).alias("done"), F.lit(1).alias("kind"))
    starts = windows.filter(F.col("start").isNotNull()).select(F.col("start").alias("at")).distinct().select(
        "at", F.lit(None).cast(ends.schema["done"].dataType).alias("done"), F.lit(0).alias("kind")
    )
    # a start sorts before an end of the same instant, so only strictly earlier ends count
    found = last_before(ends.unionByName(starts), ["at", "kind"], "done", "prior")
    found = found.filter("kind = 0").select(F.col("at").alias("start"), "prior")
    return windows.join(found, "start", "left").select(
        "name", "start", "end", F.col("prior.name").alias("prior_name"), F.col("prior.end").alias("prior_end")
    )


# --- single session ---------------------------------------------------------


def session_digest(
    messages: DataFrame, calls: DataFrame, decision_tools: Sequence[str], transitions: DataFrame
) -> DataFrame:
    """One row per session: opening, ending, counts, tools, files, decisions, transitions.

    `messages(session_id, msg_index, role, type, text, ts, tools)`. Open-ended
    lists (created and modified files, decisions, transitions) are counted here
    and stay whole in `file_activity`, `decision_points` and `phase_transitions`.
    """
    stats = messages.groupBy("session_id").agg(
        F.count("*").alias("total_messages"),
        F.coalesce(X.rounded_minutes(F.min("ts"), F.max("ts")), F.lit(0)).alias("duration_minutes"),
    )
    kinds = messages.groupBy("session_id", "role").agg(F.count("*").alias("n")).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("role", "n"))).alias("message_types")
    )
    tools = W.tool_totals(calls).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("n"), "tool"))).alias("tool_counts")
    )
    files = W.file_activity(calls).groupBy("session_id").agg(
        F.count_if(F.col("activity") == "created").alias("files_created"),
        F.count_if(F.col("activity") == "modified").alias("files_modified"),
        F.count_if(F.col("activity") == "read").alias("files_read"),
    )
    decided = W.decision_points(calls, decision_tools).groupBy("session_id").agg(F.count("*").alias("decisions"))
    moved = transitions.groupBy("session_id").agg(F.count("*").alias("transitions"))
    out = stats
    for part in (L.session_opening(messages), kinds, tools, files, decided, moved, L.session_ending(messages)):
        out = out.join(part, "session_id", "left")
    return out.fillna(0, ["files_created", "files_modified", "files_read", "decisions", "transitions"])


def review_lines(
    digest: DataFrame,
    summary: DataFrame,
    activity: DataFrame,
    decisions: DataFrame,
    transitions: DataFrame,
    caps: Sequence[int | None] = REVIEW_CAPS["meta-analysis"],
) -> DataFrame:
    """Single-session digest as `session_id, section, pos, line`, capped per use.

    Every capped list goes through a top-k per session; an uncapped list stays
    rows and is never gathered.
    """
    n_tools, n_created, n_modified, n_decisions, n_transitions = caps

    def listed(rows: DataFrame, section: int, order: Sequence[Column], cap: int | None, line: Column) -> DataFrame | None:
        if cap == 0:
            return None
        if cap is not None:
            rows = top_k(rows, ["session_id"], order, cap, "_n")
            pos = F.col("_n").cast("long")
        else:
            pos = F.col("_at").cast("long")
        return rows.select("session_id", F.lit(section).alias("section"), pos.alias("pos"), line.alias("line"))

    def s(name: str) -> Column:
        return F.col(name).cast("string")

    overview = F.array(
        F.concat(F.lit('Goal: "'), F.coalesce("initial_request", F.lit("")), F.lit('"')),
        F.concat(F.lit("Duration: ~"), s("duration_minutes"), F.lit(" minutes")),
        F.concat(F.lit("Total messages: "), s("total_messages")),
    )
    tool_line = F.concat(
        F.lit("- "), "tool", F.lit(": "), s("calls"), F.lit("x (first at msg "), s("first_msg"),
        F.lit(", last at "), s("last_msg"), F.lit(")"),
    )
    file_line = F.concat(F.lit("  - "), "file_path")
    decision_line = F.concat(F.lit("- Message "), s("msg_index"), F.lit(" ["), "tool", F.lit("]: "), "snippet")
    transition_line = F.concat(F.lit("- Message "), s("msg_index"), F.lit(": "), "indicator")
    by_pos, by_msg = [F.col("pos")], [F.col("msg_index")]
    parts = [
        digest.select("session_id", F.lit(0).alias("section"), F.posexplode(overview).alias("_p", "line")).select(
            "session_id", "section", (F.col("_p") + 1).cast("long").alias("pos"), "line"
        ),
        listed(
            summary.withColumn("_at", F.col("first_msg")), 1, [F.desc("calls"), F.col("tool")], n_tools, tool_line
        ),
        listed(activity.filter("activity = 'created'"), 2, by_pos, n_created, file_line),
        listed(activity.filter("activity = 'modified'"), 3, by_pos, n_modified, file_line),
        listed(decisions.withColumn("_at", F.col("msg_index")), 4, by_msg, n_decisions, decision_line),
        listed(transitions.withColumn("_at", F.col("msg_index")), 5, [*by_msg, F.col("kind")], n_transitions, transition_line),
        digest.select("session_id", F.lit(6).alias("section"), F.posexplode("final_messages").alias("_p", "line")).select(
            "session_id", "section", (F.col("_p") + 1).cast("long").alias("pos"), "line"
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        if part is not None:
            out = out.unionByName(part)
    return out


def join_lines(lines: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One text per key from its ordered lines; for keys with a bounded number of lines."""
    item = F.struct(*order, "line")
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("text")
    )
