"""Transcript files of two vendors to one `messages` table.

A line table has `session_id, project, source, file_path, file_size, file_mtime,
line_no, line`; the parsers turn it into

    session_id, msg_index, ts, source, project, cwd, user_text, assistant_text,
    tool_calls ARRAY<STRUCT<name, preview>>, file_paths ARRAY<STRING>, is_human_prompt
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import content as C
from skein.functions.text import has_text, strip
from skein.operators.ordered import CHUNK, chunk_of, ordinal

# Source tags and the constant project of the second vendor.
CLAUDE = "claude-code"
CODEX = "codex"
CODEX_PROJECT = "codex"
CODEX_DEPTH = 3
SESSION_NAME = r"([^/]+)\.jsonl$"

# Kept channels and text block types of rollout messages.
CHANNELS = ("final", "commentary")
ROLLOUT_TEXT = ("input_text", "output_text", "text")

MESSAGE_COLUMNS = (
    "session_id",
    "msg_index",
    "ts",
    "source",
    "project",
    "cwd",
    "user_text",
    "assistant_text",
    "tool_calls",
    "file_paths",
    "is_human_prompt",
)

ENVELOPE = (
    "type string, timestamp string, cwd string, isMeta boolean, summary string, "
    "message struct<role: string, model: string, content: string, usage: struct<"
    "input_tokens: bigint, cache_creation_input_tokens: bigint, "
    "cache_read_input_tokens: bigint, output_tokens: bigint, service_tier: string>>, "
    "is_error boolean, content string"
)
ELEMENTS = "message struct<content: array<string>>"

ROLLOUT = (
    "type string, event string, timestamp string, created_at string, cwd string, "
    "turn_context struct<cwd: string>, role string, text string, content string, tool string, "
    "payload struct<type: string, role: string, channel: string, cwd: string, text: string, "
    "message: string, tool: string, tool_call: string>"
)
ROLLOUT_ELEMENTS = "payload struct<content: array<struct<type: string, text: string>>>"


# --- scans ------------------------------------------------------------------


def _line_table(files: DataFrame, source: str, project: Column) -> DataFrame:
    path = F.col("file_path")
    ids = files.select(
        F.regexp_extract(path, SESSION_NAME, 1).alias("session_id"),
        project.alias("project"),
        F.lit(source).alias("source"),
        "*",
    )
    # a file split is one task's worth of rows, so it serves as the bucket of the ordinal
    numbered = ordinal(ids, ["file_path"], ["_block", "_row"], F.col("_block"), "line_no")
    return numbered.select(
        "session_id", "project", "source", "file_path", "file_size", "file_mtime", "line_no",
        F.col("value").alias("line"),
    )


def _read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    meta = F.col("_metadata")
    return (
        spark.read.options(**options)
        .text(path)
        .select(
            "value",
            meta["file_path"].alias("file_path"),
            meta["file_size"].alias("file_size"),
            meta["file_modification_time"].alias("file_mtime"),
            meta["file_block_start"].alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )


def read_claude_lines(spark: SparkSession, root: str) -> DataFrame:
    """`root/<project>/<session>.jsonl`, one level deep."""
    rows = _read_lines(spark, f"{root.rstrip('/')}/*/*.jsonl")
    project = F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1)
    return _line_table(rows, CLAUDE, project)


def read_codex_lines(spark: SparkSession, root: str) -> DataFrame:
    """Date tree below `root`, at most three folders deep."""
    root = root.rstrip("/")
    rows = _read_lines(spark, root, recursiveFileLookup="true", pathGlobFilter="*.jsonl")
    rel = F.regexp_replace(F.col("file_path"), r"^[a-z0-9]+:(?://)?(?=/)", "")
    depth = F.size(F.split(F.substr(rel, F.lit(len(root) + 2)), "/")) - 1
    return _line_table(rows.filter(depth <= CODEX_DEPTH), CODEX, F.lit(CODEX_PROJECT))


def read_lines(
    spark: SparkSession,
    claude_root: str | None = None,
    codex_root: str | None = None,
) -> DataFrame:
    """Both sources as one line table; leave a root out to skip its source."""
    parts = []
    if claude_root:
        parts.append(read_claude_lines(spark, claude_root))
    if codex_root:
        parts.append(read_codex_lines(spark, codex_root))
    if not parts:
        raise ValueError("name at least one root")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """file_path, session_id, file_size of every transcript below `root`; contents are not read."""
    found = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.jsonl").load(root)
    # scans skip empty files, the listing behind them does not
    every = spark.createDataFrame([(p,) for p in found.inputFiles()], "file_path string").select(
        F.regexp_replace("file_path", "^([a-z0-9]+):///", "$1:/").alias("file_path")  # as scans name it
    )
    sizes = found.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))
    return every.join(sizes, "file_path", "left").select(
        "file_path", F.regexp_extract("file_path", SESSION_NAME, 1).alias("session_id"),
        F.coalesce("file_size", F.lit(0)).alias("file_size"),
    )


def read_complete_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files still being written: text after the last line break is held back.

    Reads a whole file per row, so it suits the tail of live files; closed
    archives go through `read_lines`, which splits large files.
    """
    whole = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path")
    complete = F.regexp_extract("value", r"(?s)^(.*)\n", 1)
    held = whole.filter(F.instr("value", "\n") > 0).select(
        "file_path", F.posexplode(F.split(complete, "\n")).alias("line_no", "line")
    )
    return held.withColumn("line_no", F.col("line_no").cast("long"))


# --- parsing ----------------------------------------------------------------


def once(**cols: Column) -> Column:
    """Evaluate costly expressions once per row, as struct `_p`.

    A one-element explode keeps the optimizer from copying JSON parsing into
    every later use and into pushed-down filters.
    """
    return F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("_p")


def _timestamp(col: Column) -> Column:
    return F.try_to_timestamp(col)


def parse_claude_entries(lines: DataFrame) -> DataFrame:
    """Every well-formed line with its typed fields and content blocks."""
    elements = F.from_json("line", ELEMENTS)["message"]["content"]
    parsed = once(o=F.from_json("line", ENVELOPE), blocks=C.blocks_of(elements))
    return (
        lines.select("*", parsed)
        .select(*lines.columns, "_p.*")
        .filter(F.col("o.type").isNotNull() | F.col("o.message").isNotNull())
        .select(
            *[c for c in lines.columns if c != "line"],
            F.col("o.type").alias("type"),
            _timestamp(F.col("o.timestamp")).alias("ts"),
            F.col("o.cwd").alias("cwd"),
            F.coalesce("o.isMeta", F.lit(False)).alias("is_meta"),
            F.col("o.summary").alias("summary"),
            F.col("o.message.role").alias("role"),
            F.col("o.message.model").alias("model"),
            F.col("o.message.usage").alias("usage"),
            F.col("o.message").isNotNull().alias("has_message"),
            F.when(F.col("blocks").isNull(), F.col("o.message.content")).alias("plain"),
            "blocks",
            F.col("o.is_error").alias("is_error"),
            F.col("o.content").alias("content"),
        )
    )


def _claude_messages(lines: DataFrame) -> DataFrame:
    e = parse_claude_entries(lines)
    blocks, text = F.col("blocks"), F.col("text")
    calls = F.coalesce(C.tool_calls_of(blocks), F.array().cast("array<struct<name:string,preview:string>>"))
    empty_paths = F.array().cast("array<string>")
    user = F.col("role") == "user"
    e = e.withColumn("text", C.text_of(blocks, F.col("plain"))).withColumn("calls", calls)
    kept = e.filter(
        F.when(user, ~C.echoes_any(blocks) & has_text(text))
        .when(F.col("role") == "assistant", (text != "") | (F.size("calls") > 0))
        .otherwise(False)
    )
    return kept.select(
        "session_id", "project", "source", "line_no", "ts", "cwd",
        F.when(user, text).otherwise("").alias("user_text"),
        F.when(user, "").otherwise(text).alias("assistant_text"),
        F.when(user, F.array().cast("array<struct<name:string,preview:string>>"))
        .otherwise(F.col("calls")).alias("tool_calls"),
        F.when(user, empty_paths).otherwise(F.coalesce(C.files_of(blocks), empty_paths)).alias("file_paths"),
        user.alias("is_human_prompt"),
    )


def _codex_messages(lines: DataFrame) -> DataFrame:
    parts = F.from_json("line", ROLLOUT_ELEMENTS)["payload"]["content"]
    e = lines.select("*", once(o=F.from_json("line", ROLLOUT), parts=parts)).select(*lines.columns, "_p.*")
    rollout_text = F.array_join(
        F.transform(
            F.filter("parts", lambda b: b["type"].isin(*ROLLOUT_TEXT) & b["text"].isNotNull()),
            lambda b: b["text"],
        ),
        "\n",
    )
    is_item = F.col("o.type") == "response_item"
    kind = F.coalesce(_filled("o.type"), _filled("o.event"), F.lit(""))
    role = F.coalesce(_filled("o.role"), _filled("o.payload.role"))
    flat_text = F.coalesce(
        _filled("o.text"), _filled("o.content"), _filled("o.payload.text"), _filled("o.payload.message"), F.lit("")
    )
    e = e.select(
        "*",
        F.coalesce(is_item, F.lit(False)).alias("is_item"),
        F.when(is_item, F.col("o.payload.role"))
        .when((role == "user") | kind.isin("user_input", "turn.started"), "user")
        .when((role == "assistant") | (kind == "turn.completed") | kind.startswith("item."), "assistant")
        .alias("who"),
        F.when(is_item, rollout_text).otherwise(flat_text).alias("raw"),
        F.when(
            ~F.coalesce(is_item, F.lit(False)),
            F.coalesce("o.tool", "o.payload.tool", "o.payload.tool_call"),
        ).alias("tool"),
    )
    name = F.coalesce(F.get_json_object("tool", "$.name"), F.get_json_object("tool", "$.function"))
    args = F.coalesce(
        *[F.get_json_object("tool", f"$.{k}") for k in ("input", "args", "arguments")], F.lit("{}")
    )
    no_calls = F.array().cast("array<struct<name:string,preview:string>>")
    call = F.struct(name.alias("name"), F.left(args, F.lit(C.INPUT_PREVIEW)).alias("preview"))
    path = F.coalesce(
        *[F.get_json_object("tool", f"$.{k}") for k in ("input.file_path", "input.path", "args.file_path")]
    )
    channel = F.col("o.payload.channel")
    item_ok = (F.col("o.payload.type") == "message") & (
        (F.col("who") == "user")
        | ((F.col("who") == "assistant") & (channel.isNull() | channel.isin("", *CHANNELS)))
    )
    user = F.col("who") == "user"
    e = e.withColumn("text", F.when(user & ~F.col("is_item"), strip("raw")).otherwise(F.col("raw")))
    e = e.withColumn(
        "calls",
        F.when((F.col("who") == "assistant") & (name != ""), F.array(call)).otherwise(no_calls),
    ).withColumn(
        "paths",
        F.when(
            (F.col("who") == "assistant") & (path != ""), F.array(path)
        ).otherwise(F.array().cast("array<string>")),
    )
    kept = e.filter(
        F.when(F.col("is_item"), item_ok & has_text("text"))
        .when(user, F.col("text") != "")
        .when(F.col("who") == "assistant", (F.col("text") != "") | (F.size("calls") > 0))
        .otherwise(False)
    )
    return kept.select(
        "session_id", "project", "source", "line_no",
        _timestamp(F.coalesce("o.timestamp", "o.created_at")).alias("ts"),
        F.coalesce("o.cwd", "o.turn_context.cwd").alias("cwd"),
        F.when(user, F.col("text")).otherwise("").alias("user_text"),
        F.when(user, "").otherwise(F.col("text")).alias("assistant_text"),
        F.col("calls").alias("tool_calls"),
        F.col("paths").alias("file_paths"),
        user.alias("is_human_prompt"),
    )


def _filled(path: str) -> Column:
    """The value unless missing or empty."""
    return F.when(F.col(path) != "", F.col(path))


def parse_messages(lines: DataFrame, sources: Sequence[str] = (CLAUDE, CODEX), chunk: int = CHUNK) -> DataFrame:
    """Retained messages of both vendors, numbered from 0 within their session.

    `chunk` is the span of `line_no` that one task numbers; larger where `line_no` counts bytes.
    """
    parts = []
    if CLAUDE in sources:
        parts.append(_claude_messages(lines.filter(F.col("source") == CLAUDE)))
    if CODEX in sources:
        parts.append(_codex_messages(lines.filter(F.col("source") == CODEX)))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    numbered = ordinal(rows, ["source", "session_id"], ["line_no"], chunk_of("line_no", chunk), "msg_index")
    return numbered.select("*").select(*MESSAGE_COLUMNS, "line_no")


def working_dirs(lines: DataFrame) -> DataFrame:
    """Every working directory a line states, in either vendor's place for it."""
    obj = F.from_json(
        "line",
        "type string, cwd string, turn_context struct<cwd: string>, payload struct<cwd: string>",
    )
    payload = F.when(F.col("o.type").isin("session_meta", "turn_context"), F.col("o.payload.cwd"))
    return lines.select("session_id", "source", "line_no", once(o=obj)).select(
        "session_id", "source", "line_no", "_p.*"
    ).select(
        "session_id", "source", "line_no",
        F.coalesce("o.cwd", "o.turn_context.cwd", payload).alias("cwd"),
    ).filter("cwd is not null")


# --- discovery --------------------------------------------------------------


def discover_sessions(lines: DataFrame, preview: int = 100, look_at: int = 10) -> DataFrame:
    """One row per file: size, mtime, line count, first user text of its first lines."""
    head = parse_claude_entries(lines.filter((F.col("source") == CLAUDE) & (F.col("line_no") < look_at)))
    first_text = F.filter(C.of_type(F.col("blocks"), "text"), lambda b: b["text"].isNotNull())
    text = F.coalesce(F.col("plain"), F.try_element_at(first_text, F.lit(1))["text"], F.lit(""))
    users = head.filter((F.col("role") == "user") & (F.col("plain").isNotNull() | F.col("blocks").isNotNull()))
    firsts = users.groupBy("file_path").agg(
        F.min_by(F.left(text, F.lit(preview)), F.col("line_no")).alias("first_message")
    )
    files = lines.groupBy("session_id", "project", "source", "file_path").agg(
        F.max("file_size").alias("size"),
        F.max("file_mtime").alias("modified"),
        F.count("*").alias("line_count"),
    )
    return files.join(firsts, "file_path", "left").orderBy(F.desc("modified"), "session_id")


def conversation_metadata(entries: DataFrame) -> DataFrame:
    """First summary entry and first typed user text per session."""
    text = C.text_of(F.col("blocks"), F.col("plain"))
    is_summary = (F.col("type") == "summary") & (F.col("summary") != "")
    is_prompt = (
        (F.col("type") == "user") & (F.col("role") == "user") & ~F.col("is_meta") & has_text(text)
    )
    return entries.groupBy("session_id").agg(
        F.min_by(F.when(is_summary, F.col("summary")), F.when(is_summary, F.col("line_no"))).alias("summary"),
        F.min_by(F.when(is_prompt, strip(text)), F.when(is_prompt, F.col("line_no"))).alias("first_prompt"),
    )


def first_model(entries: DataFrame) -> DataFrame:
    """First model an assistant line names, per session."""
    named = entries.filter((F.col("type") == "assistant") & (F.col("model") != ""))
    return named.groupBy("session_id").agg(F.min_by("model", "line_no").alias("model"))
