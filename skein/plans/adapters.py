"""The shared test tables seen as transcript, telemetry, learning and usage tables.

Each adapter exists twice: as a DataFrame property of `Tables` and as a SQL view
of the same name in `VIEWS`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.ordered import chunk_of, ordinal

#: words that occur in the generated prose, in place of English cue words
TEST_WORDS = ["the", "with", "of", "und", "de"]
WORDS_RE = r"(?:^|[^A-Za-z0-9_])(?:the|with|of|und|de)(?:$|[^A-Za-z0-9_])"

EXTENSIONS = (".ts", ".md", ".json", ".py")
TOOL_OF = {"view": "Read", "click": "Edit", "purchase": "Write", "signup": "TodoWrite", "error": "Bash"}


def stamp(ts: str | Column) -> Column:
    """Timestamps leave registered queries as text."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- conversations ------------------------------------------------------

    @cached_property
    def turns(self) -> DataFrame:
        """Every conversation row, system rows included."""
        c = F.col("conv_id")
        return self.raw("conversations").select(
            c.cast("string").alias("session_id"),
            c,
            "turn",
            F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, conv_id, turn * 5)").alias("ts"),
            F.concat(F.lit("p"), (c % 7).cast("string")).alias("project"),
            F.when(c % 5 == 0, "codex").otherwise("claude-code").alias("source"),
            F.concat(F.lit("/w/p"), (c % 7).cast("string")).alias("cwd"),
            "role",
            "text",
        )

    @cached_property
    def a_msg(self) -> DataFrame:
        kept = self.turns.filter(F.col("role").isin("user", "assistant") & F.col("text").rlike(r"\S"))
        numbered = ordinal(kept, ["session_id"], ["turn"], chunk_of("turn"), "msg_index")
        user = F.col("role") == "user"
        return numbered.select(
            "session_id", "msg_index", "ts", "source", "project", "cwd",
            F.when(user, F.col("text")).otherwise("").alias("user_text"),
            F.when(user, "").otherwise(F.col("text")).alias("assistant_text"),
            F.array().cast("array<struct<name:string,preview:string>>").alias("tool_calls"),
            F.array().cast("array<string>").alias("file_paths"),
            user.alias("is_human_prompt"),
            "conv_id", "turn", "role", "text",
        )

    # --- events as a tool log -----------------------------------------------

    @cached_property
    def a_log(self) -> DataFrame:
        """Events with the parsed property."""
        return self.raw("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
            F.col("user_id").cast("string").alias("session_id"), "event_type", "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"), "props",
        )

    @cached_property
    def a_tool(self) -> DataFrame:
        hour = F.floor(F.unix_seconds("ts") / 3600)
        numbered = ordinal(self.a_log, ["session_id"], ["ts", "event_id"], hour, "msg_index")
        tool = F.create_map(*[F.lit(x) for kv in TOOL_OF.items() for x in kv])
        ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), F.col("k") % 4 + 1)
        return numbered.select(
            "session_id", "msg_index", "ts", "event_id",
            F.element_at(tool, F.col("event_type")).alias("tool"),
            (F.col("event_type") == "error").alias("is_error"),
            "k",
            F.concat(F.lit("src/f"), F.col("k").cast("string"), ext).alias("file_path"),
            F.to_json(
                F.struct(
                    F.concat(F.lit("src/f"), F.col("k").cast("string"), ext).alias("file_path"),
                    F.col("props").alias("content"),
                )
            ).alias("input"),
            "props",
        )

    @cached_property
    def a_talk(self) -> DataFrame:
        """Every event as a message."""
        return self.a_tool.select("session_id", "msg_index", "ts")

    @cached_property
    def a_call(self) -> DataFrame:
        """Tool calls of those messages: none, one or two, with failing results one message later."""
        k = F.col("k")
        one = F.when(k % 3 != 0, F.struct("tool", "file_path", "is_error"))
        two = F.when(k % 7 == 0, F.struct(
            F.when(k % 2 == 0, "AskUserQuestion").otherwise("Grep").alias("tool"), F.lit("").alias("file_path"), F.lit(False).alias("is_error")
        ))
        late = self.a_tool.withColumn("call", F.array_compact(F.array(one, two)))
        return late.select("session_id", "msg_index", "ts", F.posexplode("call").alias("call_pos", "call")).select(
            "session_id", "msg_index", "ts", "call_pos", (F.col("msg_index") + F.col("call.is_error").cast("int")).alias("result_index"),
            "call.tool", "call.file_path", "call.is_error",
        )

    @cached_property
    def a_sig(self) -> DataFrame:
        """Tool log as short messages, some with cue phrases."""
        k, t = F.col("k"), F.col("tool")
        ks = k.cast("string")
        cue = (
            F.when(t == "Bash", F.concat(F.lit("command failed with exit code "), ks))
            .when((t == "Edit") & (k % 7 == 0), F.concat(F.lit("let me try "), ks))
            .when((t == "Write") & (k % 5 == 0), F.concat(F.lit("an error in file "), ks))
            .when((t == "Read") & (k % 6 == 0), F.concat(F.lit("stop here, not that "), ks))
        )
        sparse = F.when((t == "Bash") & (k % 8 != 0), None).otherwise(cue)
        return self.a_tool.select(
            "session_id", "msg_index", "ts", "tool", "is_error",
            F.when(t.isin("Read", "TodoWrite"), "user").otherwise("assistant").alias("role"),
            F.coalesce(sparse, F.concat(F.lit("step "), ks, F.lit(" with "), F.lower(t))).alias("text"),
        )

    # --- telemetry, documents, learnings ------------------------------------

    @cached_property
    def a_skill(self) -> DataFrame:
        return self.a_log.select(
            "ts", F.col("event_type").alias("skill_name"),
            F.concat(F.lit("/w/p"), (F.col("user_id") % 7).cast("string")).alias("project_path"),
        )

    @cached_property
    def a_doc(self) -> DataFrame:
        docs = self.raw("documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text")
        pages = self.raw("pages").select(
            F.concat(F.lit("p"), F.col("page_id")).alias("doc_id"), F.col("html").alias("text")
        )
        return docs.unionAll(pages)

    @cached_property
    def a_learn(self) -> DataFrame:
        d = self.raw("documents").join(self.raw("labels"), "doc_id")
        return d.select(
            F.col("doc_id").cast("string").alias("id"),
            F.col("text").alias("problem"),
            F.concat_ws(" ", "lang", "source").alias("solution"),
            F.lit("").alias("root_cause"),
            F.lit("").alias("trigger_conditions"),
            F.array("lang", "source").alias("tags"),
            F.array("lang").alias("languages"),
            (1 + F.col("quality") * 0.1).alias("importance"),
            F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id)").alias("created_at"),
            F.when(F.col("toxic") == 1, "private").when(F.col("quality") == 1, "reviewed").alias("share_status"),
        )

    # --- annotations --------------------------------------------------------

    @cached_property
    def a_ann(self) -> DataFrame:
        n = F.length("user_text")
        return self.a_msg.filter("is_human_prompt").select(
            "session_id", "msg_index", F.col("user_text").alias("content"),
            F.concat(F.lit("note "), n.cast("string")).alias("annotation"),
            F.when(F.col("msg_index") == 0, "green").when(n % 5 == 0, "red").otherwise("yellow").alias("color"),
            F.lit("by rule").alias("reasoning"),
            F.floor(F.col("msg_index") / 3).alias("phase_id"),
        )

    @cached_property
    def a_phase(self) -> DataFrame:
        """One row per (phase, message index) with the phase's name and description."""
        heads = self.a_ann.groupBy("session_id", "phase_id").agg(
            F.min_by("content", "msg_index").alias("head")
        )
        names = heads.select(
            "session_id", "phase_id",
            F.concat(F.lit("Phase "), F.col("phase_id").cast("string"), F.lit(" "),
                     F.substring_index(F.col("head"), " ", 4)).alias("phase_name"),
            F.substring_index(F.col("head"), " ", 9).alias("description"),
        )
        return self.a_ann.select("session_id", "phase_id", "msg_index").join(names, ["session_id", "phase_id"])

    # --- usage, posts -------------------------------------------------------

    @cached_property
    def a_usage(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.concat("l_returnflag", "l_linestatus").alias("prompt_type"),
            (F.col("l_quantity").cast("int") * 100).cast("long").alias("prompt_tokens"),
            (F.col("l_linenumber") * 50).cast("long").alias("completion_tokens"),
            F.col("l_orderkey").cast("string").alias("session_id"),
            F.col("l_quantity").cast("long").alias("input_tokens"),
            (F.col("l_linenumber") * 10).cast("long").alias("cache_creation_input_tokens"),
            (F.col("l_partkey") % 1000).alias("cache_read_input_tokens"),
            (F.col("l_suppkey") % 500).alias("output_tokens"),
        )

    @cached_property
    def a_post(self) -> DataFrame:
        o = F.col("o_orderkey")
        body = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
        return self.raw("orders").select(
            o.cast("string").alias("id"),
            F.col("o_custkey").cast("string").alias("conversation_id"),
            F.date_format("o_orderdate", "'Thu' MMM dd HH:mm:ss '+0000' yyyy").alias("created"),
            F.when(o % 10 == 0, F.concat(F.lit("RT @x "), body)).otherwise(body).alias("text"),
            F.when(o % 11 != 0, o % 97).alias("like_count"),
            (o % 31).alias("retweet_count"),
            (o % 13).alias("reply_count"),
        )

    # --- proposals ----------------------------------------------------------

    @cached_property
    def a_cite(self) -> DataFrame:
        """Citations of one proposal per conversation."""
        other = F.col("conv_id") + F.col("turn") % 3 * (F.col("conv_id") % 2)
        return self.a_msg.select(
            F.col("session_id").alias("proposal_id"),
            F.concat(F.left(other.cast("string"), F.lit(8)), F.lit(":"), F.col("msg_index").cast("string")).alias("citation"),
        )

    @cached_property
    def a_prop(self) -> DataFrame:
        c = F.col("conv_id")
        return self.a_msg.filter("msg_index = 0").select(
            F.col("session_id").alias("proposal_id"),
            F.element_at(F.array(*[F.lit(x) for x in ("skill", "memory", "rule", "anti_pattern")]), (c % 4 + 1).cast("int")).alias("kind"),
            F.when(c % 11 != 0, F.concat(F.lit("Fix It #"), F.col("session_id"))).otherwise("").alias("title"),
            F.when(c % 13 != 0, F.concat("user_text", "assistant_text")).alias("body"),
            F.element_at(
                F.array(*[F.lit(x) for x in ("feedback", "wrong-tool", "reference", "rediscovery", "other")]), (c % 5 + 1).cast("int")
            ).alias("category"),
        )


VIEWS = {
    "turns": """
SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id, turn,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn * 5) AS ts,
  'p' || (conv_id % 7) AS project,
  CASE WHEN conv_id % 5 = 0 THEN 'codex' ELSE 'claude-code' END AS source,
  '/w/p' || (conv_id % 7) AS cwd, role, text
FROM conversations""",
    "a_msg": r"""
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS msg_index,
  ts, source, project, cwd,
  CASE WHEN role = 'user' THEN text ELSE '' END AS user_text,
  CASE WHEN role = 'user' THEN '' ELSE text END AS assistant_text,
  role = 'user' AS is_human_prompt, conv_id, turn, role, text
FROM turns WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\S')""",
    "a_log": """
SELECT event_id, ts, user_id, CAST(user_id AS VARCHAR) AS session_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props
FROM events""",
    "a_tool": """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS msg_index,
  ts, event_id,
  CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Edit' WHEN 'purchase' THEN 'Write'
    WHEN 'signup' THEN 'TodoWrite' ELSE 'Bash' END AS tool,
  event_type = 'error' AS is_error, k,
  'src/f' || k || CASE k % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.md' WHEN 2 THEN '.json' ELSE '.py' END AS file_path,
  props
FROM a_log""",
    "a_talk": "SELECT session_id, msg_index, ts FROM a_tool",
    "a_call": """
SELECT session_id, msg_index, ts, 0 AS call_pos, msg_index + is_error::INT AS result_index, tool, file_path, is_error FROM a_tool WHERE k % 3 <> 0
UNION ALL SELECT session_id, msg_index, ts, (k % 3 <> 0)::INT, msg_index, CASE WHEN k % 2 = 0 THEN 'AskUserQuestion' ELSE 'Grep' END, '', false
FROM a_tool WHERE k % 7 = 0""",
    "a_sig": """
SELECT session_id, msg_index, ts, tool, is_error,
  CASE WHEN tool IN ('Read', 'TodoWrite') THEN 'user' ELSE 'assistant' END AS role,
  CASE WHEN tool = 'Bash' AND k % 8 = 0 THEN 'command failed with exit code ' || k
    WHEN tool = 'Edit' AND k % 7 = 0 THEN 'let me try ' || k
    WHEN tool = 'Write' AND k % 5 = 0 THEN 'an error in file ' || k
    WHEN tool = 'Read' AND k % 6 = 0 THEN 'stop here, not that ' || k
    ELSE 'step ' || k || ' with ' || lower(tool) END AS text
FROM a_tool""",
    "a_skill": """
SELECT ts, event_type AS skill_name, '/w/p' || (user_id % 7) AS project_path FROM a_log""",
    "a_doc": """
SELECT 'd' || doc_id AS doc_id, text FROM documents
UNION ALL SELECT 'p' || page_id, html FROM pages""",
    "a_learn": """
SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS problem, d.lang || ' ' || d.source AS solution,
  [d.lang, d.source] AS tags, [d.lang] AS languages, 1 + l.quality * 0.1::DOUBLE AS importance,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS created_at,
  CASE WHEN l.toxic = 1 THEN 'private' WHEN l.quality = 1 THEN 'reviewed' END AS share_status
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "a_ann": """
SELECT session_id, msg_index, user_text AS content, 'note ' || length(user_text) AS annotation,
  CASE WHEN msg_index = 0 THEN 'green' WHEN length(user_text) % 5 = 0 THEN 'red' ELSE 'yellow' END AS color,
  'by rule' AS reasoning, msg_index // 3 AS phase_id
FROM a_msg WHERE is_human_prompt""",
    "a_phase": """
SELECT a.session_id, a.phase_id, a.msg_index,
  'Phase ' || a.phase_id || ' ' || array_to_string(string_split(h.head, ' ')[1:4], ' ') AS phase_name,
  array_to_string(string_split(h.head, ' ')[1:9], ' ') AS description
FROM a_ann a JOIN (SELECT session_id, phase_id, arg_min(content, msg_index) AS head FROM a_ann GROUP BY ALL) h
  ON h.session_id = a.session_id AND h.phase_id = a.phase_id""",
    "a_usage": """
SELECT l_returnflag || l_linestatus AS prompt_type, CAST(l_quantity AS BIGINT) * 100 AS prompt_tokens,
  l_linenumber * 50 AS completion_tokens, CAST(l_orderkey AS VARCHAR) AS session_id,
  CAST(l_quantity AS BIGINT) AS input_tokens, l_linenumber * 10 AS cache_creation_input_tokens,
  l_partkey % 1000 AS cache_read_input_tokens, l_suppkey % 500 AS output_tokens
FROM lineitem""",
    "a_post": """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS conversation_id,
  strftime(o_orderdate, 'Thu %b %d %H:%M:%S +0000 %Y') AS created,
  CASE WHEN o_orderkey % 10 = 0 THEN 'RT @x ' ELSE '' END || o_orderpriority || ' ' || o_orderstatus AS text,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 97 END AS like_count,
  o_orderkey % 31 AS retweet_count, o_orderkey % 13 AS reply_count
FROM orders""",
    "a_cite": """
SELECT session_id AS proposal_id,
  left(CAST(conv_id + turn % 3 * (conv_id % 2) AS VARCHAR), 8) || ':' || msg_index AS citation
FROM a_msg""",
    "a_prop": """
SELECT session_id AS proposal_id,
  CASE conv_id % 4 WHEN 0 THEN 'skill' WHEN 1 THEN 'memory' WHEN 2 THEN 'rule' ELSE 'anti_pattern' END AS kind,
  CASE WHEN conv_id % 11 <> 0 THEN 'Fix It #' || session_id ELSE '' END AS title,
  CASE WHEN conv_id % 13 <> 0 THEN user_text || assistant_text END AS body,
  CASE conv_id % 5 WHEN 0 THEN 'feedback' WHEN 1 THEN 'wrong-tool' WHEN 2 THEN 'reference'
    WHEN 3 THEN 'rediscovery' ELSE 'other' END AS category
FROM a_msg WHERE msg_index = 0""",
}
