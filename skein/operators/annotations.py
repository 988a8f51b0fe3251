"""Annotated messages, phases and the tables behind a session summary.

Annotations: `session_id, msg_index, content, annotation, color, reasoning`.
Phase members: `session_id, phase_id, phase_name, description, msg_index`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import timeline as L
from skein.operators.ordered import chunk_of, neighbours, ordinal, top_k

# Caps of prompts and request texts, and bounds of goal and outcome texts.
YELLOW_MIN, YELLOW_KEPT = 100, 5
CONTEXT_MESSAGES, PRIOR_CAP, CURRENT_CAP, PHASE_CAP = 3, 150, 300, 500
PHASE_NAME_BOUNDS, SENTENCE_CAP, LONE_SENTENCE_CAP = (21, 99), 200, 300
DESCRIPTION_MIN, FINAL_TEXTS, FINAL_CAP = 30, 2, 400
COLORS = ("green", "yellow", "red")


def phase_of(items: DataFrame, phases: DataFrame) -> DataFrame:
    """Add the first phase that lists the item's message, -1 for none."""
    first = phases.groupBy("session_id", "msg_index").agg(F.min("phase_id").alias("phase_id"))
    return items.drop("phase_id").join(first, ["session_id", "msg_index"], "left").withColumn(
        "phase_id", F.coalesce("phase_id", F.lit(-1))
    )


def color_stats(annotations: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("color") == c).alias(f"{c}_count") for c in COLORS]
    out = annotations.groupBy("session_id").agg(F.count("*").alias("annotated"), *counts)
    return out.withColumn("green_share", X.percent_label(F.col("green_count"), F.col("annotated"))).withColumn(
        "label", X.count_label(F.col("annotated"), "key moment")
    )


def key_prompts(annotations: DataFrame, yellow: int = YELLOW_KEPT, min_chars: int = YELLOW_MIN) -> DataFrame:
    """All green and red prompts and the first long yellow ones, by message."""
    strong = annotations.filter(F.col("color").isin("green", "red"))
    long_yellow = annotations.filter((F.col("color") == "yellow") & (F.length("content") > min_chars))
    kept = top_k(long_yellow, ["session_id"], [F.col("msg_index")], yellow, "_n").drop("_n")
    return strong.unionByName(kept)


def key_moments(annotations: DataFrame, messages: DataFrame, starts: DataFrame, page_size: int = X.PAGE_SIZE) -> DataFrame:
    """Annotated messages with their offset from the session start and a link.

    `starts(session_id, started)`: one row per session.
    """
    found = annotations.join(messages.select("session_id", "msg_index", "ts"), ["session_id", "msg_index"])
    return found.join(starts, "session_id", "left").select(
        "session_id", "msg_index", "annotation", "color",
        X.moment_label(F.col("ts"), F.col("started")).alias("time"),
        X.offset_label(F.col("ts"), F.col("started")).alias("offset"),
        X.deep_link("msg_index", page_size).alias("link"),
    )


def mark_key_messages(messages: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every message, with its annotation when it has one."""
    notes = annotations.select("session_id", "msg_index", "annotation", "color")
    return messages.join(notes, ["session_id", "msg_index"], "left").withColumn(
        "is_key", F.col("annotation").isNotNull()
    )


def _dots(col: Column, limit: int) -> Column:
    return X.cut_then_dots(col, limit, trim=False)


def annotation_context(prompts: DataFrame, phases: DataFrame, prior: int = CONTEXT_MESSAGES) -> DataFrame:
    """Request rows: current text, up to three earlier prompts, phase and its first flag.

    `prompts(session_id, msg_index, content)`.
    """
    placed = ordinal(prompts, ["session_id"], ["msg_index"], chunk_of("msg_index"), "user_no")
    item = F.struct("msg_index", _dots(F.col("content"), PRIOR_CAP).alias("content"))
    seen = neighbours(
        placed, ["session_id"], "user_no",
        {"_prior": lambda w: F.collect_list(item).over(w.rowsBetween(-prior, -1))}, before=prior,
    )
    first_phase = phases.groupBy("session_id", "msg_index").agg(
        F.min(F.struct("phase_id", "phase_name", "description")).alias("p")
    )
    starts = phases.groupBy("session_id", "phase_id").agg(F.min("msg_index").alias("_start"))
    joined = seen.join(first_phase, ["session_id", "msg_index"], "left").withColumn("phase_id", F.col("p.phase_id"))
    joined = joined.join(starts, ["session_id", "phase_id"], "left")
    lines = F.transform("_prior", lambda p: F.concat_ws(". ", p["msg_index"].cast("string"), p["content"]))
    return joined.select(
        "session_id", "msg_index", "user_no", F.array_join(lines, "\n").alias("prior_messages"),
        _dots(F.col("content"), CURRENT_CAP).alias("current"),
        F.coalesce("p.phase_name", F.lit("")).alias("phase_name"),
        F.coalesce(F.col("_start") == F.col("msg_index"), F.lit(False)).alias("first_in_phase"),
    )


def phase_requests(prompts: DataFrame, cap: int = PHASE_CAP) -> DataFrame:
    """Typed prompts with their ordinal among prompts, cut for phase detection."""
    placed = ordinal(prompts, ["session_id"], ["msg_index"], chunk_of("msg_index"), "user_no")
    line = F.concat_ws(". ", F.col("user_no").cast("string"), _dots(F.col("content"), cap))
    return placed.select("session_id", "user_no", line.alias("line"))


def _edge_phase(phases: DataFrame, last: bool) -> DataFrame:
    pick = F.max if last else F.min
    return phases.groupBy("session_id").agg(
        pick(F.struct("phase_id", "phase_name", "description")).alias("p"),
        F.count_distinct("phase_id").alias("phase_count"),
    )


def session_goal(messages: DataFrame, phases: DataFrame, annotations: DataFrame) -> DataFrame:
    """Goal from the first phase, else the first sentence, else the first green note.

    `messages(session_id, msg_index, role, text)`.
    """
    ids = messages.select("session_id").distinct()
    users = messages.filter("role = 'user'").groupBy("session_id").agg(
        F.min(F.struct("msg_index", "text")).alias("u")
    )
    greens = annotations.filter("color = 'green'").groupBy("session_id").agg(
        F.min(F.struct("msg_index", "annotation", "content")).alias("g")
    )
    j = (
        ids.join(users, "session_id", "left")
        .join(_edge_phase(phases, last=False), "session_id", "left")
        .join(greens, "session_id", "left")
    )
    sentence = X.first_sentence("u.text")
    has_phase = F.col("p").isNotNull() & F.col("u").isNotNull()
    by_phase = (
        F.when(F.length("p.phase_name").between(*PHASE_NAME_BOUNDS), F.concat_ws(". ", "p.phase_name", "p.description"))
        .when(F.length(sentence) < SENTENCE_CAP, sentence)
        .otherwise(F.col("p.description"))
    )
    by_green = F.concat_ws(": ", "g.annotation", F.left("g.content", F.lit(LONE_SENTENCE_CAP)))
    by_text = F.when(F.length(sentence) < LONE_SENTENCE_CAP, sentence).otherwise(
        F.left("u.text", F.lit(LONE_SENTENCE_CAP))
    )
    return j.select(
        "session_id",
        F.when(has_phase, by_phase)
        .when(F.col("g").isNotNull(), by_green)
        .when(F.col("u").isNotNull(), by_text)
        .otherwise("Session analysis")
        .alias("goal"),
        F.when(has_phase, F.col("u.msg_index"))
        .when(F.col("g").isNotNull(), F.col("g.msg_index"))
        .otherwise(F.coalesce("u.msg_index", F.lit(0)))
        .alias("goal_index"),
        F.when(F.col("p").isNotNull(), "annotation").otherwise("first_message").alias("goal_source"),
    )


def session_outcome(messages: DataFrame, phases: DataFrame, annotations: DataFrame) -> DataFrame:
    """Outcome from the last phase and session counts, else the last two user texts."""
    ids = messages.select("session_id").distinct()
    greens = annotations.groupBy("session_id").agg(F.count_if(F.col("color") == "green").alias("greens"))
    j = (
        ids.join(_edge_phase(phases, last=True), "session_id", "left")
        .join(greens, "session_id", "left")
        .join(L.last_user_texts(messages, FINAL_TEXTS, FINAL_CAP), "session_id", "left")
    )
    told = (F.col("p.description") != F.col("p.phase_name")) & (F.length("p.description") > DESCRIPTION_MIN)
    overall = F.concat(
        F.lit(" Overall, worked through "), F.col("phase_count").cast("string"), F.lit(" distinct phases"),
        F.when(
            F.coalesce("greens", F.lit(0)) > 0,
            F.concat(F.lit(" covering "), F.col("greens").cast("string"), F.lit(" major tasks")),
        ).otherwise(""),
        F.lit("."),
    )
    by_phase = F.concat(
        F.lit("Completed "), F.lower("p.phase_name"), F.lit(". "),
        F.when(told, F.col("p.description")).otherwise(""),
        F.when(F.col("phase_count") > 1, overall).otherwise(""),
    )
    by_text = F.concat(F.lit("Session ended with: "), "final_texts")
    return j.select(
        "session_id",
        F.when(F.col("p").isNotNull(), by_phase).otherwise(F.coalesce(by_text, F.lit("Session completed"))).alias("outcome"),
        F.when(F.col("p").isNotNull(), "last_phase").otherwise("last_messages").alias("outcome_source"),
    )


def blog_summary(
    messages: DataFrame, phases: DataFrame, annotations: DataFrame, snippets: DataFrame, lines: int = 20
) -> tuple[DataFrame, DataFrame]:
    """Head table (metadata, goal, outcome) and item table (prompts and code by phase)."""
    head = (
        L.session_metadata(messages, phases)
        .join(session_goal(messages, phases, annotations), "session_id")
        .join(session_outcome(messages, phases, annotations), "session_id")
    )
    prompts = phase_of(key_prompts(annotations), phases).select(
        "session_id", "phase_id", "msg_index", F.lit("prompt").alias("kind"), F.col("content").alias("text"),
        X.deep_link("msg_index").alias("link"),
    )
    code = phase_of(snippets, phases).select(
        "session_id", "phase_id", "msg_index", F.lit("code").alias("kind"), X.cut_lines("code", lines).alias("text"),
        F.lit("").alias("link"),
    )
    return head, prompts.unionByName(code)
