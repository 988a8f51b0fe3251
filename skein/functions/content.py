"""Content blocks of transcript lines as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import NO_TEXT, has_text

# Preview length of tool input, path keys, tools whose pattern counts as a path.
INPUT_PREVIEW = 200
PATH_KEYS = ("file_path", "path", "notebook_path")
PATTERN_TOOLS = ("Glob", "Grep")
DECISION_TOOL = "AskUserQuestion"

BLOCK = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("thinking", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("tool_use_id", T.StringType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("content", T.StringType()),
    ]
)


def blocks_of(elements: Column) -> Column:
    """Raw JSON elements of a content array to typed blocks; junk elements get a null type."""
    return F.transform(elements, lambda e: F.from_json(e, BLOCK))


def of_type(blocks: Column, kind: str) -> Column:
    return F.filter(blocks, lambda b: b["type"] == kind)


def text_of(blocks: Column, plain: Column, sep: str = "\n", missing: str = "") -> Column:
    """Plain string content as is, otherwise the text blocks joined by `sep`."""
    texts = F.transform(
        F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()),
        lambda b: b["text"],
    )
    return F.coalesce(F.when(blocks.isNull(), plain).otherwise(F.array_join(texts, sep)), F.lit(missing))


def text_or_sentinel(blocks: Column, plain: Column) -> Column:
    """Blank-joined text; content that is neither string nor array gives the sentinel."""
    return text_of(blocks, plain, " ", NO_TEXT)


def tool_calls_of(blocks: Column) -> Column:
    """`ARRAY<STRUCT<name, preview>>`, never the result of a call."""
    return F.transform(
        of_type(blocks, "tool_use"),
        lambda b: F.struct(
            F.coalesce(b["name"], F.lit("")).alias("name"),
            F.left(F.coalesce(b["input"], F.lit("{}")), F.lit(INPUT_PREVIEW)).alias("preview"),
        ),
    )


def render_calls(calls: Column) -> Column:
    return F.array_join(
        F.transform(calls, lambda c: F.trim(F.concat_ws(" ", c["name"], c["preview"]))), "\n"
    )


def call_path(tool_input: Column) -> Column:
    return F.coalesce(*[F.get_json_object(tool_input, f"$.{k}") for k in PATH_KEYS])


def call_files(name: Column, tool_input: Column) -> Column:
    """Paths named by one call: its file, and the pattern of a search tool."""
    path = call_path(tool_input)
    pattern = F.when(name.isin(*PATTERN_TOOLS), F.get_json_object(tool_input, "$.pattern"))
    return F.array_compact(F.array(F.when(path != "", path), pattern))


def files_of(blocks: Column) -> Column:
    return F.flatten(
        F.transform(of_type(blocks, "tool_use"), lambda b: call_files(b["name"], b["input"]))
    )


def echoes_any(blocks: Column) -> Column:
    """Some block is a tool result."""
    return F.coalesce(F.exists(blocks, lambda b: b["type"] == "tool_result"), F.lit(False))


def echoes_all(blocks: Column) -> Column:
    """Every block is a tool result."""
    return F.coalesce(
        F.forall(blocks, lambda b: F.coalesce(b["type"] == "tool_result", F.lit(False))), F.lit(False)
    )


def result_text(content: Column) -> Column:
    """Tool result as text: a string as is, an array as its text parts by line."""
    parts = F.from_json(content, T.ArrayType(T.StructType([T.StructField("text", T.StringType())])))
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return F.when(content.rlike(r"^\[\s*\{") & parts.isNotNull(), joined).otherwise(
        F.coalesce(content, F.lit(""))
    )


def is_blank(col: Column) -> Column:
    return ~has_text(col)
