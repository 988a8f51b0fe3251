"""Queries on projections and scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.plans.adapters import Tables
from skein.plans.registry import query


@query(
    "truncate_text",
    r"""SELECT doc_id,
      CASE WHEN length(text) > 300 THEN left(text, 299) || '…' ELSE text END AS within_ellipsis,
      CASE WHEN length(text) > 300 THEN regexp_replace(left(text, 300), '^\s+|\s+$', '', 'g') || '...' ELSE text END AS past_dots,
      CASE WHEN length(text) > 300 THEN left(text, 297) || '...' ELSE text END AS within_dots
    FROM a_doc""",
)
def truncate_text(t: Tables) -> DataFrame:
    return t.a_doc.select(
        "doc_id", X.cut_with_ellipsis("text", 300).alias("within_ellipsis"),
        X.cut_then_dots("text", 300).alias("past_dots"), X.cut_within_dots("text", 300).alias("within_dots"),
    )


@query(
    "truncate_code",
    r"""WITH cut AS (SELECT doc_id, text, left(text, 200) AS head,
        CASE WHEN instr(left(text, 200), chr(10)) > 0
          THEN 200 - length(regexp_extract(left(text, 200), '([^\n]*)$', 1)) - 1 ELSE -1 END AS kept FROM a_doc)
    SELECT doc_id, CASE WHEN length(text) <= 200 THEN text
      WHEN kept > 160 THEN left(head, kept) || chr(10) || '... [truncated]'
      ELSE head || '... [truncated]' END AS code
    FROM cut""",
)
def truncate_code(t: Tables) -> DataFrame:
    return t.a_doc.select("doc_id", X.cut_code("text", 200).alias("code"))


@query(
    "truncate_lines",
    r"""SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 5
      THEN array_to_string(string_split(text, chr(10))[1:5], chr(10)) || chr(10) || '// ... (truncated)' ELSE text END AS code
    FROM a_doc""",
)
def truncate_lines(t: Tables) -> DataFrame:
    return t.a_doc.select("doc_id", X.cut_lines("text", 5).alias("code"))


@query(
    "file_language",
    """SELECT language, count(*) AS files FROM (SELECT CASE lower(string_split(file_path, '.')[-1])
      WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'py' THEN 'python'
      ELSE 'text' END AS language FROM a_tool) GROUP BY language""",
)
def file_language(t: Tables) -> DataFrame:
    return t.a_tool.select(X.language_of("file_path").alias("language")).groupBy("language").agg(
        F.count("*").alias("files")
    )


@query(
    "deep_links",
    """SELECT session_id, msg_index, msg_index // 3 + 1 AS page,
      'page-' || lpad(CAST(msg_index // 3 + 1 AS VARCHAR), 3, '0') || '.html#msg-' || msg_index AS link FROM a_msg""",
)
def deep_links(t: Tables) -> DataFrame:
    return t.a_msg.select(
        "session_id", "msg_index", X.page_number("msg_index", 3).alias("page"), X.deep_link("msg_index", 3).alias("link")
    )


@query(
    "slugs",
    """SELECT doc_id, lower(regexp_replace(text, '[^a-zA-Z0-9-]', '-', 'g')) AS dashes,
      lower(regexp_replace(text, '[^a-zA-Z0-9_-]', '_', 'g')) AS underscores,
      left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 60) AS runs
    FROM a_doc""",
)
def slugs(t: Tables) -> DataFrame:
    return t.a_doc.select(
        "doc_id", X.slug_dashes("text").alias("dashes"), X.slug_underscores("text").alias("underscores"),
        X.slug_runs("text").alias("runs"),
    )


@query(
    "iso_week",
    """SELECT isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS iso_week, count(*) AS events
    FROM a_log GROUP BY 1""",
)
def iso_week(t: Tables) -> DataFrame:
    return t.a_log.select(X.iso_week_label("ts").alias("iso_week")).groupBy("iso_week").agg(
        F.count("*").alias("events")
    )


@query(
    "token_estimate",
    """SELECT session_id, sum(CAST(ceil(length(text) / 4.0) AS BIGINT))::BIGINT AS tokens FROM a_msg GROUP BY session_id""",
)
def token_estimate(t: Tables) -> DataFrame:
    return t.a_msg.groupBy("session_id").agg(F.sum(X.tokens_estimate("text")).cast("long").alias("tokens"))
