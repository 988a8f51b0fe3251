"""Artifacts of a session: code, commands, quotes, errors and outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.ordered import top_k
from skein.operators.tools import in_ranges

# Default artifact types and caps, length bounds, scores.
DEFAULT_TYPES = ("code", "error", "quote", "command")
CODE_CHARS, PER_SECTION, TOP_TOTAL = 1000, 10, 20
ASSISTANT_QUOTE, USER_QUOTE, OUTPUT = (51, 499), (21, 499), (11, 999)
RESULT_SNIPPET = (51, 1999)
SCORE_CODE, SCORE_WRITE, SCORE_SOURCE, SCORE_DOC, SCORE_CONFIG = 10, 5, 3, 2, 4
SCORE_ERROR, SCORE_COMMAND, SCORE_GIT, SCORE_BUILD, SCORE_QUOTE = 15, 5, 3, 5, 3
LENGTH_UNIT, LENGTH_CAP = 100, 10
SOURCE_FILE, DOC_FILE, CONFIG_FILE = r"\.(ts|tsx|js|jsx)$", r"\.md$", r"package\.json|tsconfig"
BUILD_WORDS = "test|build|npm|yarn"

INPUT_SCHEMA = "file_path string, content string, new_string string, command string, description string"

def explode_blocks(entries: DataFrame) -> DataFrame:
    """Blocks of parsed entries with unpacked tool input; plain user text becomes one block.

    `entries(session_id, msg_index, type, plain, blocks)`.
    """
    b, i = F.col("b"), F.col("i")
    e = entries.select("session_id", "msg_index", F.col("type").alias("speaker"), "plain", F.posexplode_outer("blocks").alias("block_no", "b"))
    e = e.withColumn("i", F.from_json("b.input", INPUT_SCHEMA))
    return e.select(
        "session_id", "msg_index", F.coalesce("block_no", F.lit(0)).alias("block_no"), "speaker",
        F.when(b.isNull() & F.col("plain").isNotNull(), "plain").otherwise(b["type"]).alias("kind"),
        F.coalesce(b["text"], F.when(b.isNull(), F.col("plain"))).alias("text"),
        b["name"].alias("tool"), i["file_path"].alias("file_path"), i["content"].alias("written"),
        i["new_string"].alias("edited"), i["command"].alias("command"), i["description"].alias("description"),
        F.coalesce(b["is_error"], F.lit(False)).alias("is_error"),
        F.coalesce(b["content"], F.lit("")).alias("result"),
        b["tool_use_id"].alias("tool_use_id"),
    )


def _within(col: Column, bounds: tuple[int, int]) -> Column:
    return F.length(col).between(*bounds)


def extract_artifacts(
    blocks: DataFrame, types: Sequence[str] = DEFAULT_TYPES, code_chars: int = CODE_CHARS
) -> DataFrame:
    """One artifact per matching block."""
    c = F.col
    call, result = c("kind") == "tool_use", c("kind") == "tool_result"
    filled = lambda name: F.coalesce(c(name) != "", F.lit(False))
    has_path = filled("file_path")
    by_assistant, by_user = c("speaker") == "assistant", c("speaker") == "user"
    write = by_assistant & call & (c("tool") == "Write") & filled("written") & has_path
    edit = by_assistant & call & (c("tool") == "Edit") & filled("edited") & has_path
    bash = by_assistant & call & (c("tool") == "Bash") & filled("command")
    said = by_assistant & (c("kind") == "text") & _within(c("text"), ASSISTANT_QUOTE)
    asked = by_user & (c("kind") == "plain") & _within(c("text"), USER_QUOTE)
    failed = by_user & result & c("is_error")
    output = by_user & result & ~c("is_error") & _within(c("result"), OUTPUT)

    def artifact(kind: str, content: Column, context: Column, path: Column | None = None, tool: str | None = None):
        return F.struct(
            F.lit(kind).alias("type"), content.alias("content"), context.alias("context"),
            (path if path is not None else F.lit("")).alias("file_path"), F.lit(tool or "").alias("tool_name"),
        )

    found = (
        F.when(write, artifact("code", X.cut_code("written", code_chars), F.concat(F.lit("Created "), "file_path"), c("file_path"), "Write"))
        .when(edit, artifact("code", X.cut_code("edited", code_chars), F.concat(F.lit("Modified "), "file_path"), c("file_path"), "Edit"))
        .when(bash, artifact("command", c("command"), F.coalesce("description", F.lit("Shell command")), None, "Bash"))
        .when(said, artifact("quote", c("text"), F.lit("Assistant explanation"), None, "text"))
        .when(asked, artifact("quote", c("text"), F.lit("User request")))
        .when(failed, artifact("error", X.cut_code("result", code_chars), F.concat(F.lit("Error from tool "), F.coalesce("tool_use_id", F.lit("")))))
        .when(output, artifact("output", X.cut_code("result", code_chars), F.lit("Command output")))
    )
    return (
        blocks.select("session_id", "msg_index", "block_no", found.alias("a"))
        .filter(F.col("a").isNotNull() & F.col("a.type").isin(list(types)))
        .select("session_id", "msg_index", "block_no", "a.*")
    )


def score_artifacts(artifacts: DataFrame) -> DataFrame:
    t, path, content = F.col("type"), F.col("file_path"), F.col("content")
    by_file = (
        F.when(path.rlike(SOURCE_FILE), SCORE_SOURCE)
        .when(path.rlike(DOC_FILE), SCORE_DOC)
        .when(path.rlike(CONFIG_FILE), SCORE_CONFIG)
        .otherwise(0)
    )
    base = (
        F.when(t == "code", SCORE_CODE + F.when(F.col("tool_name") == "Write", SCORE_WRITE).otherwise(0) + by_file)
        .when(t == "error", SCORE_ERROR)
        .when(
            t == "command",
            SCORE_COMMAND
            + F.when(content.contains("git"), SCORE_GIT).otherwise(0)
            + F.when(content.rlike(BUILD_WORDS), SCORE_BUILD).otherwise(0),
        )
        .when(t == "quote", SCORE_QUOTE)
        .otherwise(0)
    )
    substance = F.least(F.length(content) / F.lit(float(LENGTH_UNIT)), F.lit(float(LENGTH_CAP)))
    return artifacts.withColumn("score", F.round(base + substance, 6))


def top_artifacts(scored: DataFrame, n: int = TOP_TOTAL) -> DataFrame:
    """Best artifacts of each session with their rank."""
    return top_k(scored, ["session_id"], [F.desc("score"), F.col("msg_index"), F.col("block_no")], n, "rank")


def phase_artifacts(artifacts: DataFrame, ranges: DataFrame, cap: int = PER_SECTION) -> DataFrame:
    """First artifacts inside each phase range."""
    joined = in_ranges(artifacts, ranges)
    return top_k(joined, ["session_id", "phase_no"], [F.col("msg_index"), F.col("block_no")], cap, "rank")


def code_snippets(blocks: DataFrame, per_phase: int = 3) -> DataFrame:
    """First code-like pieces of a session: written, edited, and mid-sized results."""
    c = F.col
    call = c("kind") == "tool_use"
    name = F.coalesce(c("file_path"), F.lit("file"))

    def piece(code: Column, language: Column, context: Column, tool: str) -> Column:
        return F.struct(code.alias("code"), language.alias("language"), context.alias("context"), F.lit(tool).alias("tool_name"))

    language = X.language_of(F.coalesce(c("file_path"), F.lit("")))
    found = (
        F.when(call & (c("tool") == "Write") & (c("written") != ""), piece(c("written"), language, F.concat(F.lit("Writing "), name), "Write"))
        .when(call & (c("tool") == "Edit") & (c("edited") != ""), piece(c("edited"), language, F.concat(F.lit("Editing "), name), "Edit"))
        .when(
            (c("kind") == "tool_result") & _within(c("result"), RESULT_SNIPPET),
            piece(c("result"), F.lit(X.DEFAULT_LANGUAGE), F.lit("Result from tool"), "tool_result"),
        )
    )
    rows = blocks.select("session_id", "msg_index", "block_no", found.alias("s")).filter("s is not null")
    kept = top_k(rows, ["session_id"], [F.col("msg_index"), F.col("block_no")], 3 * per_phase, "rank")
    return kept.select("session_id", "msg_index", "rank", "s.*")
