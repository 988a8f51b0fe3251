"""Cue signals, pending tool errors, anchors and learning episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.ordered import CHUNK, chunk_of, ordinal, running_sums, top_k
from skein.session import materialise

# Cue lexicons. All are matched without regard to case.
ERROR_CUES = [
    "error", "exception", "traceback", "failed", "ENOTFOUND", "ECONNREFUSED", "exit code [1-9]", "❌",
    r"\[TOOL ERROR\]",
]
FAILURE_CUES = [r"\[TOOL ERROR\]", "command failed", "exit code [1-9]"]
CORRECTION_CUES = [
    "no,", "not that", "don't do", "stop ", "that's wrong", "instead of", "wait,? actually", "no —", "no -",
]
PIVOT_CUES = [
    "different approach", "let me try", "instead of", "actually,? let's", "won't work", "alternative",
]
DECISION_CUES = [
    "let me", "i'll", "i will", "going to", "plan", "approach", "next step", "first", "then", "finally",
    "actually", "instead", "wait", "hmm", "i think",
]
DECISION_QUESTIONS = [
    r"should\s+(we|I)", r"could\s+(we|I)", r"would\s+(you|we)", r"let'?s\s+(use|go\s+with|choose)",
    r"instead\s+of", r"better\s+(to|than)", "prefer", r"or\s+should",
    r"which\s+(one|approach|library|framework)",
]

# Limits and shape of episodes.
ERROR_PREFIX = "\n[TOOL ERROR]: "
CORRECTION_LIMIT = 500
DECISION_MIN = 80
CONTENT_LIMIT = 3000
BEFORE, AFTER = 4, 15
OVERLAP = 0.5
SUMMARY_MESSAGES, SUMMARY_CHARS = 3, 100

#: an accepted anchor this far back no longer touches a new window
_FAR = BEFORE + AFTER + 1
#: every error adds at least its prefix, so this many fill the content limit
_ERRORS_KEPT = CONTENT_LIMIT // len(ERROR_PREFIX) + 1


def correction_pattern(cues: Sequence[str] = CORRECTION_CUES) -> str:
    """Cues between word boundaries.

    A boundary after a letter needs no letter to follow; after a mark or a blank
    it needs one, so `no,wait` is a correction and `no, wait` is not.
    """
    word, edge = "[A-Za-z0-9_]", "[^A-Za-z0-9_]"
    ends = [f"{cue}(?:$|{edge})" if cue[-1].isalnum() else f"{cue}{word}" for cue in cues]
    return f"(?i)(?:^|{edge})(?:{'|'.join(ends)})"


def _like(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike(pattern), F.lit(False))


def has_error(col: Column, cues: Sequence[str] = ERROR_CUES) -> Column:
    return X.any_of(col, list(cues))


def has_failure(col: Column, cues: Sequence[str] = FAILURE_CUES) -> Column:
    return X.any_of(col, list(cues))


def corrects(col: Column, pattern: str | None = None) -> Column:
    return _like(col, pattern or correction_pattern())


def pivots(col: Column, cues: Sequence[str] = PIVOT_CUES) -> Column:
    return _like(col, X.whole_words(list(cues)))


def decides(col: Column, cues: Sequence[str] = DECISION_CUES) -> Column:
    return (F.length(col) > DECISION_MIN) & _like(col, X.whole_words(list(cues)))


def asks(col: Column, patterns: Sequence[str] = DECISION_QUESTIONS) -> Column:
    return X.any_of(col, list(patterns))


def message_signals(
    messages: DataFrame,
    correction: str | None = None,
    pivot: Sequence[str] = PIVOT_CUES,
) -> DataFrame:
    """Add the four flags to `role, text` rows."""
    t, role = F.col("text"), F.col("role")
    return messages.select(
        "*",
        has_error(t).alias("has_error"),
        has_failure(t).alias("has_failure"),
        ((role == "user") & corrects(t, correction) & (F.length(t) < CORRECTION_LIMIT)).alias("is_correction"),
        ((role == "assistant") & pivots(t, pivot)).alias("is_pivot"),
    )


def carry_errors(entries: DataFrame) -> DataFrame:
    """Attach tool errors to the next message of their session.

    `entries` holds `session_id, line_no, role, text` for messages (role set)
    and for errors (role null). Flags look at the whole text of the message and
    of every error before it; `content` is that text cut to the limit. Errors
    after the last message are dropped, as are messages left without text.
    Errors are reduced per message before they are joined, so no run of errors
    is ever concatenated whole.
    """
    is_message = F.col("role").isNotNull()
    counted = running_sums(
        entries, ["session_id"], ["line_no"], chunk_of("line_no"),
        {"slot": F.when(is_message, 1).otherwise(0).cast("long")},
    )
    slot = F.when(is_message, F.col("slot") - 1).otherwise(F.col("slot"))
    # messages, error facts, error texts and positions all start here
    counted = materialise(counted.withColumn("slot", slot), "slots")
    messages = counted.filter(is_message)
    errors = counted.filter(~is_message & (F.col("text") != "")).select(
        "session_id", "slot", "line_no", F.concat(F.lit(ERROR_PREFIX), "text").alias("piece")
    )
    keys = ["session_id", "slot"]
    facts = errors.groupBy(*keys).agg(
        F.count("*").alias("n_errors"),
        F.sum(F.length("piece")).alias("error_chars"),
        F.max(corrects(F.col("piece"))).alias("e_corrects"),
        F.max(pivots(F.col("piece"))).alias("e_pivots"),
    )
    head = top_k(errors, keys, [F.col("line_no")], _ERRORS_KEPT, "_n")
    pieces = F.array_sort(F.collect_list(F.struct("_n", F.left("piece", F.lit(CONTENT_LIMIT)).alias("piece"))))
    shown = head.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda e: e["piece"]), "").alias("e_text"))
    told = messages.filter(X.has_text("text")).select(*keys).unionByName(errors.select(*keys)).distinct()
    placed = ordinal(told, ["session_id"], ["slot"], chunk_of("slot"), "pos")
    m = messages.join(placed, keys).join(facts, keys, "left").join(shown, keys, "left")
    t, role, any_error = F.col("text"), F.col("role"), F.col("n_errors").isNotNull()
    total = F.length("text") + F.coalesce("error_chars", F.lit(0))
    return m.select(
        "session_id", "line_no", "role",
        F.left(F.concat("text", F.coalesce("e_text", F.lit(""))), F.lit(CONTENT_LIMIT)).alias("content"),
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
        (has_error(t) | any_error).alias("has_error"),
        (has_failure(t) | any_error).alias("has_failure"),
        (
            (role == "user") & (corrects(t) | F.coalesce("e_corrects", F.lit(False))) & (total < CORRECTION_LIMIT)
        ).alias("is_correction"),
        ((role == "assistant") & (pivots(t) | F.coalesce("e_pivots", F.lit(False)))).alias("is_pivot"),
        "pos",
    )


def with_signal(flagged: DataFrame) -> DataFrame:
    """Add the strongest signal a message carries, null when none."""
    signal = (
        F.when(F.col("has_failure"), "tool_failure")
        .when(F.col("has_error"), "error_recovery")
        .when(F.col("is_correction"), "user_correction")
        .when(F.col("is_pivot"), "approach_pivot")
    )
    return flagged.withColumn("signal", signal)


def anchors(flagged: DataFrame) -> DataFrame:
    """Messages that open an episode."""
    return with_signal(flagged).filter("signal is not null")


# --- episodes ---------------------------------------------------------------
#
# An anchor is kept unless more than half of its window is covered by the last
# kept window. That is a left-to-right pass with one number of state: how far
# back the last kept anchor lies, where 20 or more means "no influence". A chunk
# of a session therefore acts as a table from 21 entry states to 21 exit states.
# Tables compose, so long sessions are passed in parallel: tables per chunk,
# one pass over the tables, then every chunk again from its known entry state.


def _accepts(a: Column, last: Column, n: Column) -> Column:
    start = F.greatest(a - BEFORE, F.lit(0))
    end = F.least(a + AFTER, n - 1)
    covered = F.greatest(F.least(last + AFTER, n - 1) - start + 1, F.lit(0))
    return covered <= (end - start + 1) * OVERLAP


def _exit_state(arr: Column, n: Column, start: Column, end: Column, entry: Column) -> Column:
    last = F.aggregate(
        arr, start - entry, lambda acc, a: F.when(_accepts(a, acc, n), a).otherwise(acc)
    )
    return F.least(end - last, F.lit(_FAR)).cast("long")


def _compose(tables: Column, entry: Column) -> Column:
    """Exit state after a sorted run of tables; a gap between tables resets the state."""
    init = F.struct(entry.cast("long").alias("st"), F.lit(None).cast("long").alias("prev"))

    def step(acc: Column, x: Column) -> Column:
        st = F.when(acc["prev"].isNull() | (x["first"] == acc["prev"] + 1), acc["st"]).otherwise(_FAR)
        return F.struct(x["table"][st.cast("int")].alias("st"), x["last"].alias("prev"))

    return F.aggregate(tables, init, step, lambda acc: acc["st"])


def _entries(tables: Column, entry: Column) -> Column:
    """Entry state of every table of a sorted run."""
    init = F.struct(
        entry.cast("long").alias("st"), F.lit(None).cast("long").alias("prev"),
        F.array().cast("array<struct<first:bigint,entry:bigint>>").alias("seen"),
    )

    def step(acc: Column, x: Column) -> Column:
        st = F.when(acc["prev"].isNull() | (x["first"] == acc["prev"] + 1), acc["st"]).otherwise(
            F.lit(_FAR).cast("long")
        )
        here = F.array(F.struct(x["first"].alias("first"), st.alias("entry")))
        return F.struct(
            x["table"][st.cast("int")].alias("st"), x["last"].alias("prev"), F.concat(acc["seen"], here).alias("seen")
        )

    return F.aggregate(tables, init, step, lambda acc: acc["seen"])


def _entry_states(chunks: DataFrame, size: int, fan: int) -> DataFrame:
    """Entry state of each chunk of the sessions that span several chunks."""
    states = F.transform(F.sequence(F.lit(0), F.lit(_FAR)), lambda s: s.cast("long"))
    start, end = F.col("chunk") * size, (F.col("chunk") + 1) * size
    tables = chunks.filter(F.col("n") > size).select(
        "session_id", F.floor(F.col("chunk") / fan).alias("group"),
        F.struct(
            F.col("chunk").alias("first"), F.col("chunk").alias("last"),
            F.transform(states, lambda s: _exit_state(F.col("arr"), F.col("n"), start, end, s)).alias("table"),
        ).alias("t"),
    )
    runs = tables.groupBy("session_id", "group").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    whole = runs.select(
        "session_id",
        F.struct(
            F.col("ts")[0]["first"].alias("first"), F.element_at("ts", -1)["last"].alias("last"),
            F.transform(states, lambda s: _compose(F.col("ts"), s)).alias("table"),
        ).alias("t"),
    )
    tops = whole.groupBy("session_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    group_entry = tops.select(
        "session_id", F.explode(_entries(F.col("ts"), F.lit(_FAR))).alias("e")
    ).select("session_id", F.floor(F.col("e.first") / fan).alias("group"), F.col("e.entry").alias("entry"))
    return (
        runs.join(group_entry, ["session_id", "group"])
        .select("session_id", F.explode(_entries(F.col("ts"), F.col("entry"))).alias("e"))
        .select("session_id", F.col("e.first").alias("chunk"), F.col("e.entry").alias("entry"))
    )


def select_episodes(flagged: DataFrame, size: int = CHUNK, fan: int = CHUNK) -> DataFrame:
    """Kept anchors with their windows: `session_id, anchor, signal, start, end`.

    `flagged(session_id, pos, signal)` holds every message, with a null signal
    where it opens nothing. `size` is the positions per chunk (20 or more),
    `fan` the chunks per group.
    """
    if size < _FAR:
        raise ValueError(f"a chunk needs at least {_FAR} positions")
    lengths = flagged.groupBy("session_id").agg(F.count("*").alias("n"))
    chunks = (
        flagged.filter("signal is not null")
        .groupBy("session_id", chunk_of("pos", size).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "signal"))).alias("rows"))
        .join(lengths, "session_id")
        .withColumn("arr", F.transform("rows", lambda r: r["pos"]))
    )
    entry = _entry_states(chunks, size, fan)
    known = chunks.join(entry, ["session_id", "chunk"], "left")
    init = F.struct(
        (F.col("chunk") * size - F.coalesce("entry", F.lit(_FAR))).alias("last"),
        F.array().cast("array<struct<pos:bigint,signal:string>>").alias("kept"),
    )

    def step(acc: Column, r: Column) -> Column:
        keep = F.struct(r["pos"].alias("last"), F.concat(acc["kept"], F.array(r)).alias("kept"))
        return F.when(_accepts(r["pos"], acc["last"], F.col("n")), keep).otherwise(acc)

    kept = known.select(
        "session_id", "n", F.explode(F.aggregate("rows", init, step, lambda acc: acc["kept"])).alias("k")
    )
    pos = F.col("k.pos")
    return kept.select(
        "session_id", pos.alias("anchor"), F.col("k.signal").alias("signal"),
        F.greatest(pos - BEFORE, F.lit(0)).alias("start"), F.least(pos + AFTER, F.col("n") - 1).alias("end"),
    )


def episode_messages(episodes: DataFrame, flagged: DataFrame) -> DataFrame:
    """Messages of each episode; joins on (session, position), at most 20 per episode."""
    places = episodes.select(
        "session_id", "anchor", "signal", "start", "end", F.explode(F.sequence("start", "end")).alias("pos")
    )
    return places.join(flagged.drop("signal"), ["session_id", "pos"])


def render_episodes(messages: DataFrame) -> DataFrame:
    """One row per episode: line range, summary and the flagged request text."""
    label = F.concat(
        F.lit("["), "role",
        F.when(F.col("has_error"), " ERROR").otherwise(""),
        F.when(F.col("is_correction"), " CORRECTION").otherwise(""),
        F.when(F.col("is_pivot"), " PIVOT").otherwise(""),
        F.lit("]: "), "content",
    )
    item = F.struct("pos", "line_no", F.left("content", F.lit(SUMMARY_CHARS)).alias("head"), label.alias("line"))
    grouped = messages.groupBy("session_id", "anchor", "signal").agg(
        F.array_sort(F.collect_list(item)).alias("m")
    )
    return grouped.select(
        "session_id", "anchor", "signal",
        F.col("m")[0]["line_no"].alias("start_line"), F.element_at("m", -1)["line_no"].alias("end_line"),
        F.size("m").alias("n_messages"),
        F.array_join(
            F.transform(F.slice("m", 1, SUMMARY_MESSAGES), lambda x: x["head"]), " | "
        ).alias("summary"),
        F.array_join(F.transform("m", lambda x: x["line"]), "\n\n").alias("request"),
    )


def episodes(flagged: DataFrame, size: int = CHUNK, fan: int = CHUNK) -> DataFrame:
    """Segment every session; the flagged messages are written once and read three times."""
    stored = materialise(with_signal(flagged), "flagged")
    chosen = select_episodes(stored, size, fan)
    return render_episodes(episode_messages(chosen, stored))
