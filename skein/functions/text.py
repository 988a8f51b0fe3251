"""Text shaping as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language.
LANGUAGES = {
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "py": "python",
    "rb": "ruby",
    "java": "java",
    "cpp": "cpp",
    "c": "c",
    "go": "go",
    "rs": "rust",
    "md": "markdown",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "html": "html",
    "css": "css",
    "scss": "scss",
    "sh": "bash",
}
DEFAULT_LANGUAGE = "text"

# Markers and limits of rendered text.
NO_TEXT = "[no text content]"
CODE_CUT_MARK = "... [truncated]"
LINES_CUT_MARK = "// ... (truncated)"
CHARS_PER_TOKEN = 4
PAGE_SIZE = 50
RULE_SLUG_LENGTH = 60


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: str | Column) -> Column:
    """Trim any whitespace, not only blanks."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def has_text(col: str | Column) -> Column:
    return F.coalesce(_c(col).rlike(r"\S"), F.lit(False))


# --- truncation -------------------------------------------------------------


def cut_with_ellipsis(col: str | Column, limit: int) -> Column:
    """At most `limit` characters, the last one an ellipsis when cut."""
    c = _c(col)
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 1)), F.lit("…"))).otherwise(c)


def cut_then_dots(col: str | Column, limit: int, trim: bool = True) -> Column:
    """First `limit` characters, then three dots past the limit when cut."""
    c = _c(col)
    head = F.left(c, F.lit(limit))
    head = strip(head) if trim else head
    return F.when(F.length(c) > limit, F.concat(head, F.lit("..."))).otherwise(c)


def cut_within_dots(col: str | Column, limit: int) -> Column:
    """At most `limit` characters, the last three dots when cut."""
    c = _c(col)
    return F.when(
        F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))
    ).otherwise(c)


def cut_code(col: str | Column, limit: int) -> Column:
    """Cut at the last line break when it lies past 80 % of the limit."""
    c = _c(col)
    head = F.left(c, F.lit(limit))
    from_end = F.instr(F.reverse(head), "\n")
    kept = F.when(from_end > 0, F.lit(limit) - from_end).otherwise(-1)
    return (
        F.when(F.length(c) <= limit, c)
        .when(kept > limit * 0.8, F.concat(F.left(head, kept), F.lit("\n" + CODE_CUT_MARK)))
        .otherwise(F.concat(head, F.lit(CODE_CUT_MARK)))
    )


def cut_lines(col: str | Column, limit: int) -> Column:
    c = _c(col)
    lines = F.split(c, "\n")
    return F.when(
        F.size(lines) > limit,
        F.concat(F.array_join(F.slice(lines, 1, limit), "\n"), F.lit("\n" + LINES_CUT_MARK)),
    ).otherwise(c)


def collapse(col: str | Column) -> Column:
    return F.regexp_replace(_c(col), r"\s+", " ")


def first_sentence(col: str | Column) -> Column:
    return strip(F.element_at(F.split(_c(col), "[.!?]"), 1))


# --- names, paths, labels ---------------------------------------------------


def language_of(path: str | Column) -> Column:
    ext = F.lower(F.substring_index(_c(path), ".", -1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit(DEFAULT_LANGUAGE))


def last_segment(path: str | Column) -> Column:
    parts = F.filter(F.split(_c(path), "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), _c(path))


def citation(session_id: str | Column, msg_index: str | Column) -> Column:
    return F.concat(
        F.lit("["), F.left(_c(session_id), F.lit(8)), F.lit(":"), _c(msg_index).cast("string"), F.lit("]")
    )


#: what a slug has no place for, as ranges: Java's matcher takes several times longer for the same class negated
NOT_DASHED = r"[\x00-,./:-@\[-`{-\x{10ffff}]"
NOT_UNDERSCORED = r"[\x00-,./:-@\[-^`{-\x{10ffff}]"
NOT_IN_RUN = r"[\x00-/:-`{-\x{10ffff}]+"
#: times its limit, the part of a text that is tried first for a slug of limited length
SLUG_HEAD = 8


def slug_dashes(col: str | Column) -> Column:
    return F.lower(F.regexp_replace(_c(col), NOT_DASHED, "-"))


def slug_underscores(col: str | Column) -> Column:
    return F.lower(F.regexp_replace(_c(col), NOT_UNDERSCORED, "_"))


def slug_runs(col: str | Column, limit: int = RULE_SLUG_LENGTH) -> Column:
    """Runs of other characters as one dash, none at the ends, cut to `limit`."""

    def dashed(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), NOT_IN_RUN, "-")

    c = _c(col)
    # the head's slug begins the whole one; two characters more than the limit are enough to cut it
    head = dashed(F.left(c, F.lit(SLUG_HEAD * limit)))
    enough = F.when(F.length(head) >= limit + 2, head).otherwise(dashed(c))
    return F.left(F.regexp_replace(enough, "^-|-$", ""), F.lit(limit))


def model_label(col: str | Column) -> Column:
    """`family-name-4-5-20250929` becomes `Family Name 4.5`."""
    undated = F.regexp_replace(_c(col), "-[0-9]{8}$", "")
    dotted = F.regexp_replace(undated, "(?<=^|-)([0-9]+)-(?=[0-9]+(?:-|$))", "$1.")
    words = F.transform(
        F.split(dotted, "-"),
        lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))),
    )
    return F.array_join(words, " ")


def tokens_estimate(col: str | Column) -> Column:
    return F.ceil(F.length(_c(col)) / CHARS_PER_TOKEN)


def size_label(col: str | Column) -> Column:
    c = _c(col)
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024 * 1024, F.format_string("%.1f KB", c / 1024.0))
        .otherwise(F.format_string("%.1f MB", c / (1024.0 * 1024.0)))
    )


def percent_label(part: Column, total: Column) -> Column:
    pct = F.floor(part / total * 100 + 0.5).cast("long")
    return F.when(total == 0, F.lit("0%")).otherwise(F.concat(pct.cast("string"), F.lit("%")))


def count_label(n: Column, singular: str, plural: str | None = None) -> Column:
    word = F.when(n == 1, F.lit(singular)).otherwise(F.lit(plural or singular + "s"))
    return F.concat(n.cast("string"), F.lit(" "), word)


# --- time -------------------------------------------------------------------


def _hours_minutes(minutes: Column) -> Column:
    hours, rest = F.floor(minutes / 60).cast("string"), minutes % 60
    return F.when(
        rest > 0, F.concat(hours, F.lit("h "), rest.cast("string"), F.lit("m"))
    ).otherwise(F.concat(hours, F.lit("h")))


def duration_label(minutes: str | Column, floor_label: str | None = "< 1 min") -> Column:
    """Minutes as text; `floor_label` replaces values under one minute."""
    m = _c(minutes)
    plain = F.concat(m.cast("string"), F.lit(" min"))
    label = F.when(m < 60, plain).otherwise(_hours_minutes(m))
    return label if floor_label is None else F.when(m < 1, F.lit(floor_label)).otherwise(label)


def offset_label(ts: Column, start: Column) -> Column:
    """Whole minutes since the session start, floored."""
    return duration_label(F.floor((_micros(ts) - _micros(start)) / 60000000).cast("long"), "0 min")


def moment_label(ts: Column, start: Column) -> Column:
    """Rounded minutes since the session start, `Start` for none."""
    m = F.floor((_micros(ts) - _micros(start)) / 60000000 + 0.5).cast("long")
    label = F.when(m > 0, F.concat(m.cast("string"), F.lit(" min"))).otherwise(F.lit("Start"))
    return F.when(ts.isNull() | start.isNull(), F.lit("")).otherwise(label)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def minutes_between(first: Column, last: Column) -> Column:
    """Minutes as a double."""
    return (_micros(last) - _micros(first)) / 60000000.0


def rounded_minutes(first: Column, last: Column) -> Column:
    return F.floor(minutes_between(first, last) + 0.5).cast("long")


def iso_week_label(ts: str | Column) -> Column:
    t = _c(ts)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), t).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(t).cast("string"), 2, "0"),
    )


# --- pages ------------------------------------------------------------------


def page_number(msg_index: str | Column, page_size: int = PAGE_SIZE) -> Column:
    return (F.floor(_c(msg_index) / page_size) + 1).cast("long")


def page_name(number: Column) -> Column:
    digits = number.cast("string")
    padded = F.when(F.length(digits) >= 3, digits).otherwise(F.lpad(digits, 3, "0"))
    return F.concat(F.lit("page-"), padded, F.lit(".html"))


def deep_link(msg_index: str | Column, page_size: int = PAGE_SIZE, base: str | None = None) -> Column:
    idx = _c(msg_index)
    link = F.concat(page_name(page_number(idx, page_size)), F.lit("#msg-"), idx.cast("string"))
    return link if base is None else F.concat(F.lit(base + "/"), link)


# --- tokens -----------------------------------------------------------------


def _accent_table() -> tuple[str, str]:
    """Letters with a canonical base letter, and combining marks (mapped to nothing)."""
    src, dst, marks = [], [], []
    for lo, hi in ((0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000)):
        for cp in range(lo, hi):
            parts = unicodedata.normalize("NFD", chr(cp))
            base = "".join(ch for ch in parts if not unicodedata.combining(ch))
            if len(parts) > 1 and len(base) == 1:
                src.append(chr(cp))
                dst.append(base)
    marks = [chr(cp) for cp in range(0x0300, 0x0370)]
    return "".join(src + marks), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def fold(col: str | Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(_c(col)), _ACCENTED, _PLAIN)


def tokens(col: str | Column) -> Column:
    """Maximal runs of letters and digits, folded."""
    parts = F.split(F.coalesce(fold(col), F.lit("")), r"[^\p{L}\p{N}]+")
    return F.array_remove(parts, "")


def any_of(col: str | Column, patterns: list[str]) -> Column:
    """True when one of the case-insensitive patterns occurs."""
    return F.coalesce(_c(col).rlike("(?i)(?:" + "|".join(patterns) + ")"), F.lit(False))


def whole_words(phrases: list[str]) -> str:
    """Pattern for phrases between ASCII word boundaries."""
    return r"(?i)(?:^|[^A-Za-z0-9_])(?:" + "|".join(phrases) + r")(?:$|[^A-Za-z0-9_])"
