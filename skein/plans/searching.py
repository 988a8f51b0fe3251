"""Queries on search, ranking and message windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.stem import stem_word
from skein.operators import search as Q
from skein.operators import segments
from skein.operators import sessions as S
from skein.plans.adapters import Tables, stamp
from skein.plans.ingest import SESSIONS_SQL
from skein.plans.registry import query
from skein.session import shared_folder

TERMS = ["the", "with", "edit", "ts", "und"]

TOK = r"list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

_FIELDS = ("user_text", "assistant_text", "tool_calls", "file_paths")

# messages and tool log as one searchable corpus, its tokens and its scores
CORPUS = """
corpus AS (
  SELECT session_id, msg_index, user_text, assistant_text, '' AS tool_calls, '' AS file_paths FROM a_msg
  UNION ALL SELECT 'u' || session_id, msg_index, '', '', tool || ' ' || props, file_path FROM a_tool),
toks AS (SELECT session_id, msg_index, {lists} FROM corpus),
docs AS (SELECT *, {dl} AS dl FROM toks),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs)""".format(
    lists=", ".join(f"{TOK.format(f)} AS {f}" for f in _FIELDS),
    dl=" + ".join(f"len({f})" for f in _FIELDS),
)
OCC = "occ AS (" + " UNION ALL ".join(
    f"SELECT session_id, msg_index, dl, '{f}' AS field, unnest({f}) AS term, generate_subscripts({f}, 1) - 1 AS pos FROM docs"
    for f in _FIELDS
) + ")"
SCORES = f"""{CORPUS}, {OCC},
hits AS (SELECT session_id, msg_index, dl, term, sum(CASE field WHEN 'user_text' THEN 8.0::DOUBLE
    WHEN 'assistant_text' THEN 3.0 WHEN 'tool_calls' THEN 1.5 ELSE 7.0 END) AS wtf
  FROM occ WHERE term IN ('the', 'with', 'edit', 'ts', 'und') GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scores AS (SELECT session_id, msg_index, round(sum(
    greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * wtf * 2.2
      / (wtf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM hits JOIN dfs USING (term), stats GROUP BY session_id, msg_index)"""


def corpus(t: Tables) -> DataFrame:
    said = t.a_msg.select(
        "session_id", "msg_index", "user_text", "assistant_text", F.lit("").alias("tool_calls"),
        F.lit("").alias("file_paths"),
    )
    done = t.a_tool.select(
        F.concat(F.lit("u"), "session_id").alias("session_id"), "msg_index", F.lit("").alias("user_text"),
        F.lit("").alias("assistant_text"), F.concat_ws(" ", "tool", "props").alias("tool_calls"),
        F.col("file_path").alias("file_paths"),
    )
    return said.unionByName(done)


def index(t: Tables, stem: bool = False) -> Q.Index:
    return Q.build_index(corpus(t), stem=stem)


@query(
    "tokens",
    f"""SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, array_to_string(w, ' ') AS tokens
    FROM (SELECT doc_id, {TOK.format('text')} AS w FROM a_doc)""",
)
def tokens(t: Tables) -> DataFrame:
    w = F.col("w")
    return t.a_doc.select("doc_id", X.tokens("text").alias("w")).select(
        "doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_distinct"),
        F.array_join(w, " ").alias("tokens"),
    )


@query("stemmed_terms")
def stemmed_terms(t: Tables) -> DataFrame:
    words = t.a_doc.select(F.explode(X.tokens("text")).alias("term")).groupBy("term").agg(
        F.count("*").alias("occurrences")
    )
    stems = words.select(stem_word(F.col("term")).alias("stem"), "term", "occurrences")
    return stems.groupBy("stem").agg(
        F.count("*").alias("forms"), F.sum("occurrences").alias("occurrences")
    )


@query(
    "vocabulary",
    f"""WITH {CORPUS}, {OCC}
    SELECT term, count(DISTINCT session_id || ':' || msg_index) AS df, count(*) AS occurrences FROM occ GROUP BY term""",
)
def vocabulary(t: Tables) -> DataFrame:
    return Q.vocabulary(corpus(t), stem=False)


@query(
    "term_stats",
    f"""WITH {CORPUS}, {OCC}
    SELECT term, count(DISTINCT session_id || ':' || msg_index) AS df, count(*) AS occurrences FROM occ GROUP BY term""",
)
def term_stats(t: Tables) -> DataFrame:
    return Q.term_stats(index(t))


@query("bm25_scores", f"WITH {SCORES} SELECT * FROM scores")
def bm25_scores(t: Tables) -> DataFrame:
    return Q.bm25(index(t), TERMS).withColumn("score", F.round("score", 6))


_ALL_SESSIONS = f"""SELECT session_id, project, source, msg_count FROM ({SESSIONS_SQL})
  UNION ALL SELECT 'u' || session_id, 'tools', 'claude-code', count(*) FROM a_tool GROUP BY session_id"""


def all_sessions(t: Tables) -> DataFrame:
    talk = S.session_rollup(t.a_msg).select("session_id", "project", "source", "msg_count")
    tools = t.a_tool.groupBy(F.concat(F.lit("u"), "session_id").alias("session_id")).agg(
        F.lit("tools").alias("project"), F.lit("claude-code").alias("source"), F.count("*").alias("msg_count")
    )
    return talk.unionByName(tools.select("session_id", "project", "source", "msg_count"))


@query("bm25_scan", f"WITH {SCORES} SELECT * FROM scores")
def bm25_scan(t: Tables) -> DataFrame:
    return Q.bm25_scan(corpus(t), TERMS, stem=False).withColumn("score", F.round("score", 6))


@query(
    "search_sessions",
    f"""WITH {SCORES}, best AS (SELECT session_id, max(score) AS score FROM scores GROUP BY session_id)
    SELECT b.session_id, b.score, (SELECT min(msg_index) FROM scores s WHERE s.session_id = b.session_id
        AND s.score = b.score) AS best_msg_index, project, source, msg_count
    FROM best b JOIN ({_ALL_SESSIONS}) m ON m.session_id = b.session_id
    WHERE source = 'claude-code' ORDER BY b.score DESC, b.session_id LIMIT 10""",
)
def search_sessions(t: Tables) -> DataFrame:
    scores = Q.bm25_scan(corpus(t), TERMS, stem=False)
    return Q.best_sessions(scores, all_sessions(t), sources=["claude-code"])


@query("search_sessions_stemmed")
def search_sessions_stemmed(t: Tables) -> DataFrame:
    terms = Q.query_terms(["Editing", "thanes", "with"])
    return Q.search_sessions(Q.build_index(corpus(t), only=terms), all_sessions(t), terms)


@query(
    "search_batch",
    f"""WITH {CORPUS}, {OCC},
    asked AS (SELECT DISTINCT conv_id AS query_id, w AS term FROM (
        SELECT conv_id, unnest({TOK.format('text')}) AS w FROM turns WHERE turn = 0) WHERE length(w) > 5),
    hits AS (SELECT session_id, msg_index, dl, term, sum(CASE field WHEN 'user_text' THEN 8.0::DOUBLE
        WHEN 'assistant_text' THEN 3.0 WHEN 'tool_calls' THEN 1.5 ELSE 7.0 END) AS wtf FROM occ GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
    scored AS (SELECT query_id, session_id, msg_index, round(sum(
        greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * wtf * 2.2
          / (wtf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM hits JOIN dfs USING (term) JOIN asked USING (term), stats GROUP BY ALL),
    best AS (SELECT query_id, session_id, score, msg_index AS best_msg_index FROM scored QUALIFY row_number() OVER (
        PARTITION BY query_id, session_id ORDER BY score DESC, msg_index) = 1)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id) AS rank FROM best
    QUALIFY rank <= 3""",
)
def search_batch(t: Tables) -> DataFrame:
    words = t.turns.filter("turn = 0").select(
        F.col("conv_id").alias("query_id"), F.explode(X.tokens("text")).alias("term")
    )
    return Q.search_batch(index(t), words.filter(F.length("term") > 5), k=3)


_LEFT = """corpus AS (
  SELECT * REPLACE (CASE WHEN right(session_id, 1) = '3' THEN 'edit ' || user_text ELSE user_text END AS user_text)
  FROM whole WHERE right(session_id, 1) <> '7')"""


@query(
    "index_segments",
    f"""WITH {SCORES.replace("corpus AS (", "whole AS (", 1).replace("toks AS", _LEFT + "," + chr(10) + "toks AS", 1)} SELECT * FROM scores""",
)
def index_segments(t: Tables) -> DataFrame:
    """Two appends, sessions deleted, sessions replaced, segments merged: scores of what is left."""
    spark, rows = t.a_msg.sparkSession, corpus(t)
    folder, last = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", F.right("session_id", F.lit(1))
    segments.append(rows.filter(F.startswith("session_id", F.lit("u"))), folder, stem=False)
    segments.append(rows.filter(~F.startswith("session_id", F.lit("u"))), folder, stem=False)
    segments.delete(rows.filter(last == "7").select("session_id").distinct(), folder)
    again = rows.filter(last == "3")
    edited = again.withColumn("user_text", F.concat(F.lit("edit "), "user_text"))
    segments.replace(edited, again.select("session_id").distinct(), folder, stem=False)
    segments.merge(spark, folder, fan=2)
    return Q.bm25(segments.read(spark, folder), TERMS).withColumn("score", F.round("score", 6))


@query(
    "search_boolean",
    f"""WITH {CORPUS}, {OCC}
    SELECT session_id, msg_index FROM occ GROUP BY session_id, msg_index
    HAVING count(*) FILTER (term = 'the') > 0 AND count(*) FILTER (term IN ('with', 'of')) > 0
      AND count(*) FILTER (term = 'and') = 0""",
)
def search_boolean(t: Tables) -> DataFrame:
    return Q.match_boolean(index(t), ["the"], ["with", "of"], ["and"])


@query(
    "search_phrase",
    f"""WITH {CORPUS}, {OCC}
    SELECT a.session_id, a.msg_index, a.field, count(*) AS places FROM occ a JOIN occ b
      ON a.session_id = b.session_id AND a.msg_index = b.msg_index AND a.field = b.field AND b.pos = a.pos + 1
    WHERE a.term = 'with' AND b.term = 'the' GROUP BY ALL""",
)
def search_phrase(t: Tables) -> DataFrame:
    return Q.match_phrase(index(t), ["with", "the"])


@query(
    "search_field",
    f"""WITH {CORPUS}, {OCC}
    SELECT session_id, msg_index, count(*) AS occurrences FROM occ
    WHERE field = 'file_paths' AND term IN ('src', 'ts') GROUP BY session_id, msg_index
    HAVING count(DISTINCT term) = 2""",
)
def search_field(t: Tables) -> DataFrame:
    return Q.match_field(index(t), "file_paths", ["src", "ts"])


SNIPPETS_SQL = rf"""
w AS (SELECT session_id, msg_index, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM a_msg),
f AS (SELECT *, list_transform(words, lambda x: list_has_any({TOK.format('x').replace('lambda x: x <>', 'lambda y: y <>')}, [{{terms}}])) AS hits FROM w),
p AS (SELECT *, list_position(hits, true) AS hit FROM f),
s AS (SELECT *, greatest(hit - 5, 1) AS start FROM p WHERE hit > 0),
snip AS (SELECT session_id, msg_index, CASE WHEN start > 1 THEN '…' ELSE '' END || array_to_string(
    list_transform(range(start, least(start + 20, len(words) + 1)),
      lambda i: CASE WHEN hits[i] THEN '[' || words[i] || ']' ELSE words[i] END), ' ')
    || CASE WHEN start + 19 < len(words) THEN '…' ELSE '' END AS snippet FROM s)"""


def snippets_sql(terms: list[str]) -> str:
    return SNIPPETS_SQL.replace("{terms}", ", ".join(f"'{t}'" for t in terms))


@query("snippets", f"WITH {snippets_sql(['the', 'with'])} SELECT * FROM snip")
def snippets(t: Tables) -> DataFrame:
    out = t.a_msg.select("session_id", "msg_index", Q.snippet("text", ["the", "with"]).alias("snippet"))
    return out.filter("snippet is not null")


BEST = {"the": 0.4, "with": 1.7, "and": 0.9, "of": 1.1}

BEST_SQL = rf"""
w AS (SELECT session_id, msg_index, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM a_msg),
f AS (SELECT *, list_transform(words, lambda x: list_distinct(list_intersect(
    {TOK.format('x').replace('lambda x: x <>', 'lambda y: y <>')}, ['the', 'with', 'and', 'of']))) AS hits FROM w),
h AS (SELECT session_id, msg_index, words, hits, unnest(list_filter(range(1, len(words) + 1), lambda i: len(hits[i]) > 0)) AS hit FROM f),
s AS (SELECT *, greatest(hit - 5, 1) AS start FROM h),
m AS (SELECT *, list_distinct(flatten(hits[start:start + 19])) AS met FROM s),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id, msg_index ORDER BY len(met) DESC,
    round(list_sum(list_transform(met, lambda t: CASE t WHEN 'the' THEN 0.4::DOUBLE WHEN 'with' THEN 1.7 WHEN 'and' THEN 0.9 ELSE 1.1 END)), 6) DESC,
    start) = 1)
SELECT session_id, msg_index, CASE WHEN start > 1 THEN '…' ELSE '' END || array_to_string(
    list_transform(range(start, least(start + 20, len(words) + 1)),
      lambda i: CASE WHEN len(hits[i]) > 0 THEN '[' || words[i] || ']' ELSE words[i] END), ' ')
    || CASE WHEN start + 19 < len(words) THEN '…' ELSE '' END AS snippet FROM best"""


@query("best_snippets", f"WITH {BEST_SQL}")
def best_snippets(t: Tables) -> DataFrame:
    out = t.a_msg.select("session_id", "msg_index", Q.best_snippet("text", list(BEST), BEST).alias("snippet"))
    return out.filter("snippet is not null")


@query(
    "search_prefix",
    f"""WITH {CORPUS}, {OCC},
    hits AS (SELECT session_id, msg_index, dl, CASE WHEN term LIKE 'th%' THEN 'th*' WHEN term LIKE 'ed%' THEN 'ed*' ELSE term END AS term,
        sum(CASE field WHEN 'user_text' THEN 8.0::DOUBLE WHEN 'assistant_text' THEN 3.0 WHEN 'tool_calls' THEN 1.5 ELSE 7.0 END) AS wtf
      FROM occ WHERE term LIKE 'th%' OR term LIKE 'ed%' OR term = 'with' GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term)
    SELECT session_id, msg_index, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * wtf * 2.2
          / (wtf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM hits JOIN dfs USING (term), stats GROUP BY session_id, msg_index""",
)
def search_prefix(t: Tables) -> DataFrame:
    terms, prefixes = ["with"], ["th", "ed"]
    some = Q.build_index(corpus(t), stem=False, only=terms, prefixes=prefixes)
    return Q.bm25_prefixes(some, terms, prefixes).withColumn("score", F.round("score", 6))


@query(
    "search_hits",
    f"""WITH {SCORES}, best AS (SELECT session_id, max(score) AS score FROM scores GROUP BY session_id),
    top AS (SELECT b.session_id, b.score, (SELECT min(msg_index) FROM scores s WHERE s.session_id = b.session_id
        AND s.score = b.score) AS best_msg_index FROM best b SEMI JOIN a_msg m ON m.session_id = b.session_id ORDER BY b.score DESC, b.session_id LIMIT 10),
    {snippets_sql(TERMS)}
    SELECT t.session_id, score, best_msg_index, strftime(ts, '%Y-%m-%d %H:%M:%S') AS best_ts, snippet
    FROM top t JOIN a_msg m ON m.session_id = t.session_id AND m.msg_index = best_msg_index
    LEFT JOIN snip n ON n.session_id = t.session_id AND n.msg_index = best_msg_index""",
)
def search_hits(t: Tables) -> DataFrame:
    talk = S.session_rollup(t.a_msg).select("session_id")
    found = Q.best_sessions(Q.bm25_scan(corpus(t), TERMS, stem=False), talk)
    out = Q.hit_context(found, t.a_msg, TERMS, stem=False)
    return out.select("session_id", "score", "best_msg_index", stamp("best_ts").alias("best_ts"), "snippet")


@query(
    "read_window",
    """WITH req AS (SELECT session_id || ':' || msg_index AS request_id, session_id, msg_index + 1 AS target FROM a_msg),
    near AS (SELECT r.request_id, r.session_id, target, m.msg_index,
        CASE WHEN user_text <> '' THEN 'user' ELSE 'assistant' END AS role, m.text,
        row_number() OVER (PARTITION BY request_id ORDER BY m.msg_index) AS rn,
        count(*) OVER (PARTITION BY request_id) AS n
      FROM req r JOIN a_msg m ON m.session_id = r.session_id
        AND m.msg_index BETWEEN greatest(target - 3, 0) AND target + 3),
    mid AS (SELECT *, coalesce(min(CASE WHEN msg_index >= target THEN rn END) OVER (PARTITION BY request_id), 1) AS mid FROM near),
    ord AS (SELECT *, row_number() OVER (PARTITION BY request_id
        ORDER BY abs(rn - mid), CASE WHEN rn >= mid THEN 0 ELSE 1 END) AS turn FROM mid),
    spent AS (SELECT *, 1000 - coalesce(sum(length(text)) OVER (PARTITION BY request_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain FROM ord)
    SELECT request_id, session_id, msg_index, role, left(text, greatest(remain, 0)::INTEGER) AS text
    FROM spent WHERE turn = 1 OR remain > 0""",
)
def read_window(t: Tables) -> DataFrame:
    requests = t.a_msg.select(
        F.concat_ws(":", "session_id", "msg_index").alias("request_id"), "session_id",
        (F.col("msg_index") + 1).alias("target"),
    )
    out = Q.read_windows(S.searchable(t.a_msg.drop("text")), requests, max_tokens=250, radius=3)
    return out.select("request_id", "session_id", "msg_index", "role", "text")
