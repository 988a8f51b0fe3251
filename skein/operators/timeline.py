"""Windows, turns, pages and edges of single sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import signals as G
from skein.operators.ordered import chunk_of, neighbours, ordinal, running_sums, top_k

# Caps of window payloads, openings, endings and simplified transcripts.
PLAIN_CAP, BLOCK_CAP = 500, 300
OPENING_CAP, CONTEXT_CAP, OPENING_MESSAGES = 500, 200, 5
ENDING_MESSAGES = 3
TEXT_CAP, OUTPUT_CAP = 1000, 500
CUT_MARK = "...[truncated]"


def message_windows(messages: DataFrame, n: int, cap: int = PLAIN_CAP) -> DataFrame:
    """Consecutive windows of `n` messages; an incomplete last window is dropped.

    `messages(session_id, msg_index, role, text, tools, files, ts)`. The group
    key is (session, window), so no group exceeds `n` rows.
    """
    shown = F.coalesce(F.nullif(X.strip(F.left("text", F.lit(cap))), F.lit("")), F.lit(X.NO_TEXT))
    item = F.struct("msg_index", "role", shown.alias("content"), "tools", "files", "ts")
    grouped = messages.groupBy("session_id", F.floor(F.col("msg_index") / n).alias("window_no")).agg(
        F.array_sort(F.collect_list(item)).alias("m"), F.count("*").alias("n_messages")
    )
    return grouped.filter(F.col("n_messages") == n).select(
        "session_id", "window_no", "n_messages",
        F.array_min(F.transform("m", lambda x: x["ts"])).alias("first_ts"),
        F.array_max(F.transform("m", lambda x: x["ts"])).alias("last_ts"),
        F.array_join(F.transform("m", lambda x: F.concat_ws(": ", x["role"], x["content"])), "\n").alias("body"),
        F.array_join(F.flatten(F.transform("m", lambda x: x["tools"])), ",").alias("tools"),
        F.array_join(F.flatten(F.transform("m", lambda x: x["files"])), ",").alias("files"),
    )


def likely_decisions(
    messages: DataFrame,
    n: int,
    patterns: Sequence[str] = G.DECISION_QUESTIONS,
    ask_tools: Sequence[str] = ("AskUserQuestion",),
) -> DataFrame:
    """Windows whose joined text matches a pattern or that call a decision tool."""
    item = F.struct("msg_index", "text")
    grouped = messages.groupBy("session_id", F.floor(F.col("msg_index") / n).alias("window_no")).agg(
        F.array_sort(F.collect_list(item)).alias("m"),
        F.max(F.arrays_overlap("tools", F.array(*[F.lit(t) for t in ask_tools]))).alias("asked"),
    )
    joined = F.array_join(F.transform("m", lambda x: x["text"]), " ")
    return grouped.select(
        "session_id", "window_no", (G.asks(joined, patterns) | F.coalesce("asked", F.lit(False))).alias("likely")
    )


def assign_turns(rows: DataFrame) -> DataFrame:
    """Number the speaker turns of `session_id, pos, role, is_echo, is_meta` rows.

    Same-role neighbours share a turn. Tool-result echoes vanish inside an
    assistant turn but end a user turn; every system row stands alone; meta rows
    at the head of a user turn are dropped. `pos` must be dense.
    """
    keys = ["session_id"]
    seen = neighbours(
        rows, keys, "pos", {"_after_echo": lambda w: F.coalesce(F.lag("is_echo").over(w), F.lit(False))}, before=1
    ).filter(~F.col("is_echo"))
    dense = ordinal(seen, keys, ["pos"], chunk_of("pos"), "_at")
    marked = neighbours(dense, keys, "_at", {"_prev": lambda w: F.lag("role").over(w)}, before=1)
    fresh = (
        F.col("_prev").isNull()
        | (F.col("_prev") != F.col("role"))
        | (F.col("role") == "system")
        | ((F.col("role") == "user") & F.col("_after_echo"))
    )
    numbered = running_sums(
        marked, keys, ["_at"], chunk_of("_at"), {"turn_no": F.when(fresh, 1).otherwise(0).cast("long")}
    ).drop("_at", "_prev", "_after_echo")
    shows = F.when((F.col("role") != "user") | ~F.col("is_meta"), F.col("pos"))
    heads = numbered.groupBy("session_id", "turn_no").agg(F.min(shows).alias("_head"))
    return numbered.join(heads, ["session_id", "turn_no"]).filter("pos >= _head").drop("_head")


def turn_table(assigned: DataFrame) -> DataFrame:
    """One row per turn. The text of a turn stays in `assign_turns`, ordered by `pos`."""
    return assigned.groupBy("session_id", "turn_no").agg(
        F.first("role").alias("role"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("chars"),
    )


def pages(messages: DataFrame, phases: DataFrame, size: int = X.PAGE_SIZE) -> DataFrame:
    """Pages of a session with neighbours and the phase of the first message.

    `phases(session_id, phase_id, phase_name, msg_index)`; the first phase wins.
    """
    number = X.page_number("msg_index", size)
    per_page = messages.groupBy("session_id", number.alias("page")).agg(
        F.min("msg_index").alias("first_index"), F.count("*").alias("n_messages")
    )
    totals = messages.groupBy("session_id").agg(F.max(number).alias("total_pages"))
    named = phases.groupBy("session_id", F.col("msg_index").alias("first_index")).agg(
        F.min_by("phase_name", "phase_id").alias("current_phase")
    )
    page = F.col("page")
    return (
        per_page.join(totals, "session_id")
        .join(named, ["session_id", "first_index"], "left")
        .select(
            "session_id", "page", "total_pages", "first_index", "n_messages",
            F.coalesce("current_phase", F.lit("")).alias("current_phase"),
            F.when(page > 1, X.page_name(page - 1)).otherwise("").alias("prev_page"),
            F.when(page < F.col("total_pages"), X.page_name(page + 1)).otherwise("").alias("next_page"),
        )
    )


def phase_ranges(transitions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Ranges between `transitions(session_id, msg_index, kind, indicator)`.

    The first range starts at 1, the others at their own index; each ends at
    the next transition or at the session length.
    """
    keys, order = ["session_id"], ["msg_index", "kind"]
    placed = ordinal(transitions, keys, order, chunk_of("msg_index"), "_at")
    led = neighbours(placed, keys, "_at", {"_next": lambda w: F.lead("msg_index").over(w)}, after=1)
    return led.join(lengths, "session_id").select(
        "session_id", (F.col("_at") + 1).alias("phase_no"),
        F.concat(F.lit("Phase "), (F.col("_at") + 1).cast("string")).alias("name"),
        F.when(F.col("_at") == 0, 1).otherwise(F.col("msg_index")).alias("start"),
        F.coalesce("_next", "n").alias("end"), "indicator",
    )


def session_opening(messages: DataFrame) -> DataFrame:
    """First request and the up to four user texts after it.

    `messages(session_id, msg_index, role, text)`; the sentinel text is skipped.
    """
    firsts = top_k(
        messages.filter("role = 'user'"), ["session_id"], [F.col("msg_index")], OPENING_MESSAGES, "_n"
    )
    text = F.left("text", F.lit(CONTEXT_CAP))
    useful = (F.col("_n") > 1) & (text != "") & (text != X.NO_TEXT)
    grouped = firsts.groupBy("session_id").agg(
        F.max(F.when(F.col("_n") == 1, F.left("text", F.lit(OPENING_CAP)))).alias("initial_request"),
        F.array_sort(F.collect_list(F.when(useful, F.struct("_n", text.alias("text"))))).alias("_c"),
    )
    return grouped.select(
        "session_id", "initial_request", F.transform("_c", lambda c: c["text"]).alias("early_context")
    )


def session_ending(messages: DataFrame) -> DataFrame:
    """Last three assistant texts and the distinct tools they call, in first-seen order."""
    lasts = top_k(
        messages.filter("role = 'assistant'"), ["session_id"], [F.desc("msg_index")], ENDING_MESSAGES, "_n"
    )
    grouped = lasts.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("msg_index", F.left("text", F.lit(CONTEXT_CAP)).alias("text"), "tools"))).alias("m")
    )
    return grouped.select(
        "session_id", F.transform("m", lambda x: x["text"]).alias("final_messages"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: x["tools"]))).alias("final_tools"),
    )


def message_gaps(messages: DataFrame) -> DataFrame:
    """Seconds since the previous message, and the share of the session before this one."""
    lagged = neighbours(
        messages.select("session_id", "msg_index", "ts"), ["session_id"], "msg_index",
        {"_prev": lambda w: F.lag("ts").over(w)}, before=1,
    )
    sizes = messages.groupBy("session_id").agg(F.count("*").alias("_n"))
    gap = F.unix_seconds("ts") - F.unix_seconds("_prev")
    return lagged.join(sizes, "session_id").select(
        "session_id", "msg_index", F.coalesce(gap, F.lit(0)).alias("gap_seconds"),
        F.round(F.col("msg_index") / F.col("_n"), 6).alias("share_before"),
    )


def capped(col: str | Column, limit: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(CUT_MARK))).otherwise(c)


def numbered_transcript(rows: DataFrame, cap: int = TEXT_CAP) -> DataFrame:
    """Rows without system and snapshot entries, numbered from 1, long texts cut.

    `rows(session_id, line_no, type, text)`.
    """
    kept = rows.filter(~F.col("type").isin("system", "file-history-snapshot"))
    placed = ordinal(kept, ["session_id"], ["line_no"], chunk_of("line_no"), "message_no")
    return placed.select(
        "session_id", (F.col("message_no") + 1).alias("message_no"), F.upper("type").alias("speaker"),
        capped("text", cap).alias("text"), (F.length("text") > cap).alias("was_cut"),
    )


def transcript_blocks(entries: DataFrame, text_cap: int = TEXT_CAP, output_cap: int = OUTPUT_CAP) -> DataFrame:
    """Rendered parts of numbered messages, one row per block.

    `entries(session_id, message_no, type, plain, blocks)` as parsed; user
    arrays show tool results only, assistant arrays show texts and calls.
    """
    b = F.col("b")
    exploded = entries.select("session_id", "message_no", "type", "plain", F.posexplode_outer("blocks").alias("block_no", "b"))
    body = (
        F.when(F.col("plain").isNotNull() & (F.col("type") == "user"), capped("plain", text_cap))
        .when((F.col("type") == "user") & (b["type"] == "tool_result"), capped(F.coalesce(b["content"], F.lit("")), output_cap))
        .when((F.col("type") == "assistant") & (b["type"] == "text"), capped(b["text"], text_cap))
        .when((F.col("type") == "assistant") & (b["type"] == "tool_use"), b["input"])
    )
    label = (
        F.when(b["type"] == "tool_result", F.concat(F.lit("Tool Result ("), F.coalesce(b["tool_use_id"], F.lit("")), F.lit(")")))
        .when(b["type"] == "tool_use", F.concat(F.lit("Tool: "), b["name"]))
        .otherwise("")
    )
    return exploded.select(
        "session_id", "message_no", "type", F.coalesce("block_no", F.lit(0)).alias("block_no"), label.alias("label"),
        body.alias("body"), F.coalesce(b["is_error"], F.lit(False)).alias("is_error"),
    ).filter("body is not null")


def session_metadata(messages: DataFrame, phases: DataFrame) -> DataFrame:
    """Span, counts and duration labels. `messages(session_id, msg_index, ts, role, tools)`."""
    first, last = F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("msg_index"))), F.max_by(
        "ts", F.when(F.col("ts").isNotNull(), F.col("msg_index"))
    )
    base = messages.groupBy("session_id").agg(
        first.alias("start_time"), last.alias("end_time"), F.count("*").alias("message_count"),
        F.count_if(F.col("role") == "user").alias("user_message_count"),
        F.min("ts").alias("_lo"), F.max("ts").alias("_hi"),
    )
    used = messages.select("session_id", F.explode("tools").alias("tool")).groupBy("session_id").agg(
        F.count_distinct("tool").alias("tools_used")
    )
    counted = phases.groupBy("session_id").agg(F.count_distinct("phase_id").alias("phase_count"))
    minutes = F.floor(X.minutes_between(F.col("start_time"), F.col("end_time"))).cast("long")
    return (
        base.join(used, "session_id", "left")
        .join(counted, "session_id", "left")
        .select(
            "session_id", "start_time", "end_time", "message_count", "user_message_count",
            F.coalesce("tools_used", F.lit(0)).alias("tools_used"),
            F.coalesce("phase_count", F.lit(0)).alias("phase_count"),
            X.duration_label(minutes).alias("duration"),
            X.duration_label(X.rounded_minutes(F.col("_lo"), F.col("_hi")), None).alias("duration_rounded"),
        )
    )


def type_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id", "type").agg(F.count("*").alias("messages"))


def last_user_texts(messages: DataFrame, n: int = 2, cap: int = 400) -> DataFrame:
    lasts = top_k(messages.filter("role = 'user'"), ["session_id"], [F.desc("msg_index")], n, "_n")
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("msg_index", "text"))), lambda x: x["text"]), " "
    )
    return lasts.groupBy("session_id").agg(F.left(joined, F.lit(cap)).alias("final_texts"))
