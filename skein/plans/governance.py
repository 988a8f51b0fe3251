"""Queries on redaction, learnings, proposals, telemetry, usage and posts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import learnings as E
from skein.operators import identity
from skein.operators import proposals as P
from skein.operators import redact as Z
from skein.operators import reports as T
from skein.plans.adapters import Tables, stamp
from skein.plans.registry import query

# --- redaction --------------------------------------------------------------

# what the other engine writes differently: it has no look-behind
DIALECT = {
    "AWS secret key": (r"(AWS_SECRET_ACCESS_KEY[=:]\s*)[A-Za-z0-9/+=]{40}", r"\1[REDACTED_AWS_SECRET]"),
    "Generic secret": (
        r"((?i:secret|token|password|api_key|apikey|auth)[=:]\s*[\"']?)[A-Za-z0-9_\-]{20,}",
        r"\1[REDACTED_SECRET]",
    ),
    "IP address": (
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
        "[REDACTED_IP]",
    ),
}
PATTERNS = [
    (rule.name, *(part.replace("'", "''") for part in DIALECT.get(rule.name, (rule.pattern, rule.replacement))))
    for rule in Z.RULES
]
REDACT_SQL = "r0 AS (SELECT doc_id, text AS t, 0 AS n, '' AS ty FROM a_doc)" + "".join(
    f""",
r{i + 1} AS (SELECT doc_id, regexp_replace(t, '{p}', '{r}', 'g') AS t, n + len(regexp_extract_all(t, '{p}')) AS n,
  ty || CASE WHEN regexp_matches(t, '{p}') THEN '{name}|' ELSE '' END AS ty FROM r{i})"""
    for i, (name, p, r) in enumerate(PATTERNS)
)


@query(
    "redact",
    f"WITH {REDACT_SQL} SELECT doc_id, t AS redacted, n AS redaction_count, ty AS redacted_types FROM r13",
)
def redact(t: Tables) -> DataFrame:
    types = F.array_join(F.transform("redacted_types", lambda x: F.concat(x, F.lit("|"))), "")
    return Z.redact(t.a_doc).select("doc_id", "redacted", "redaction_count", types.alias("redacted_types"))


_TYPES = " || ".join(f"CASE WHEN contains(string_agg(ty, ''), '{n}|') THEN ', {n}' ELSE '' END" for n, _, _ in PATTERNS)


@query(
    "redaction_summary",
    f"""WITH {REDACT_SQL}, s AS (SELECT count(*) AS files, coalesce(sum(n), 0)::BIGINT AS total_redactions, substr({_TYPES}, 3) AS types FROM r13)
    SELECT files, total_redactions, types, CASE WHEN total_redactions > 0 THEN '🔒 Redacted ' || total_redactions || ' sensitive item(s): ' || types
      ELSE '✅ No sensitive content detected' END AS summary FROM s""",
)
def redaction_summary(t: Tables) -> DataFrame:
    return Z.redaction_summary(Z.redact(t.a_doc))


@query(
    "redaction_facts",
    f"WITH {REDACT_SQL} SELECT id, n AS redactions, ty AS types FROM a_learn JOIN r13 ON doc_id = 'd' || id",
)
def redaction_facts(t: Tables) -> DataFrame:
    docs = Z.redact(t.a_doc).withColumnRenamed("doc_id", "key")
    out = Z.attach_summary(t.a_learn.withColumn("key", F.concat(F.lit("d"), "id")), docs, "key")
    types = F.array_join(F.transform("redaction_summary.types", lambda x: F.concat(x, F.lit("|"))), "")
    return out.select("id", F.col("redaction_summary.count").alias("redactions"), types.alias("types"))


# --- learnings --------------------------------------------------------------

NOW = datetime(2024, 1, 2)


@query(
    "learnings_recent",
    "SELECT id, problem, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM a_learn ORDER BY created_at DESC, id LIMIT 10",
)
def learnings_recent(t: Tables) -> DataFrame:
    return E.recent(t.a_learn).select("id", "problem", stamp("created_at").alias("created_at"))


@query(
    "learning_by_id",
    """SELECT id, problem, solution, importance FROM a_learn
    WHERE id IN (SELECT session_id FROM a_log WHERE event_type = 'view')""",
)
def learning_by_id(t: Tables) -> DataFrame:
    asked = _log(t).filter("kind = 'retrieved'")
    return E.by_ids(t.a_learn, asked).select("id", "problem", "solution", "importance")


@query(
    "search_learnings",
    """WITH s AS (SELECT *, lower(problem || '  ' || solution || ' ') AS txt FROM a_learn),
    p AS (SELECT *, contains(txt, 'the')::INT + contains(txt, 'with')::INT + contains(txt, 'und')::INT
        + CASE WHEN contains(txt, 'the with und') THEN 3 ELSE 0 END + 2 * (list_contains(tags, 'en')::INT + list_contains(tags, 'en')::INT)
        + list_contains(languages, 'de')::INT + (created_at > TIMESTAMP '2024-01-02' - INTERVAL 7 DAYS)::INT AS points FROM s)
    SELECT id, round(points * importance, 6) AS score FROM p WHERE points > 1
    ORDER BY round(points * importance, 6) DESC, created_at DESC, id LIMIT 25""",
)
def search_learnings(t: Tables) -> DataFrame:
    out = E.search(t.a_learn, "the with und", NOW, tags=["EN", "en"], language="de", limit=25)
    return out.select("id", "score")


KIND = "CASE event_type WHEN 'view' THEN 'retrieved' WHEN 'purchase' THEN 'useful' WHEN 'error' THEN 'useless' ELSE 'other' END"


def _log(t: Tables) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "view", "retrieved")
        .when(F.col("event_type") == "purchase", "useful")
        .when(F.col("event_type") == "error", "useless")
        .otherwise("other")
    )
    return t.a_log.select(F.col("session_id").alias("id"), "ts", "event_id", kind.alias("kind"), "event_type", "k")


@query(
    "learning_counters",
    """SELECT session_id AS id, count(*) FILTER (event_type = 'view') AS times_retrieved,
      count(*) FILTER (event_type = 'purchase') AS times_useful FROM a_log GROUP BY session_id""",
)
def learning_counters(t: Tables) -> DataFrame:
    return E.counters(_log(t))


@query(
    "learning_importance",
    f"""WITH RECURSIVE f AS (SELECT session_id AS id, CASE WHEN kind = 'useful' THEN 1 ELSE -1 END AS d,
        row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n
      FROM (SELECT *, {KIND} AS kind FROM a_log) WHERE kind IN ('useful', 'useless')),
    fold AS (SELECT f.id, n, greatest(3, coalesce(round(importance * 10)::BIGINT, 10) + d) AS x FROM f LEFT JOIN a_learn l ON l.id = f.id WHERE n = 1
      UNION ALL SELECT f.id, f.n, greatest(3, x + d) FROM fold JOIN f ON f.id = fold.id AND f.n = fold.n + 1)
    SELECT id, max(n) AS votes, round(arg_max(x, n) * 0.1::DOUBLE, 6) AS importance FROM fold GROUP BY id""",
)
def learning_importance(t: Tables) -> DataFrame:
    votes = _log(t).filter(F.col("kind").isin("useful", "useless"))
    hour = F.floor(F.unix_seconds("ts") / 3600)
    return E.importance(votes.withColumn("useful", F.col("kind") == "useful"), hour, ["ts", "event_id"], t.a_learn)


ACTION = """CASE WHEN event_type = 'signup' AND k = 0 THEN 'delete' WHEN event_type = 'purchase' THEN 'share'
  WHEN event_type = 'error' AND k % 4 = 0 THEN 'private' WHEN event_type = 'click' THEN 'edit-tags' ELSE 'skip' END"""


def _decisions(t: Tables) -> DataFrame:
    return t.a_log.select(
        F.col("session_id").alias("id"), F.struct("ts", "event_id").alias("at"), F.expr(ACTION).alias("action")
    )


@query(
    "review_status",
    f"""WITH RECURSIVE d AS (SELECT session_id AS id, ts, {ACTION} AS action, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM a_log),
    fold AS (SELECT id, 0::BIGINT AS n, 'local' AS st, NULL::TIMESTAMP AS r FROM d GROUP BY id
      UNION ALL SELECT d.id, d.n, CASE WHEN st = 'gone' OR action = 'delete' THEN 'gone' WHEN action = 'share' THEN 'reviewed'
          WHEN action = 'private' THEN 'private' WHEN action = 'edit-tags' THEN CASE WHEN st = 'private' THEN 'private' ELSE 'local' END ELSE st END,
        CASE WHEN action IN ('share', 'private') THEN ts WHEN action = 'edit-tags' AND st <> 'private' THEN NULL ELSE r END
      FROM fold JOIN d ON d.id = fold.id AND d.n = fold.n + 1)
    SELECT id, arg_max(st, n) AS share_status, coalesce(max(strftime(r, '%Y-%m-%d %H:%M:%S')) FILTER (n = m), '') AS reviewed_at
    FROM (SELECT *, max(n) OVER (PARTITION BY id) AS m FROM fold) GROUP BY id HAVING arg_max(st, n) <> 'gone'""",
)
def review_status(t: Tables) -> DataFrame:
    out = E.review_status(_decisions(t))
    return out.select("id", "share_status", F.coalesce(stamp("reviewed_at.ts"), F.lit("")).alias("reviewed_at"))


@query("review_queue", "SELECT id, problem FROM a_learn WHERE coalesce(share_status, 'local') = 'local'")
def review_queue(t: Tables) -> DataFrame:
    return E.review_queue(t.a_learn).select("id", "problem")


@query("shareable", "SELECT id FROM a_learn WHERE share_status = 'reviewed'")
def shareable(t: Tables) -> DataFrame:
    return E.shareable(t.a_learn).select("id")


@query(
    "pending_review",
    """SELECT id FROM a_learn WHERE share_status IS DISTINCT FROM 'reviewed'
    UNION SELECT CAST(doc_id AS VARCHAR) FROM documents
    EXCEPT SELECT id FROM a_learn WHERE share_status IS NOT NULL""",
)
def pending_review(t: Tables) -> DataFrame:
    new = t.raw("documents").select(F.col("doc_id").cast("string").alias("id"))
    open_ = t.a_learn.filter(~F.coalesce(F.col("share_status") == "reviewed", F.lit(False)))
    return E.pending_review(open_, new, t.a_learn.filter("share_status is not null"))


# --- proposals --------------------------------------------------------------

VALID_SQL = """
sup AS (SELECT proposal_id, count(DISTINCT split_part(citation, ':', 1)) AS sessions FROM a_cite GROUP BY proposal_id),
val AS (SELECT p.*, coalesce(sessions, 0) AS sessions, CASE
  WHEN coalesce(sessions, 0) < 2 THEN 'only ' || coalesce(sessions, 0) || ' distinct session(s)' || CASE WHEN kind IN ('skill', 'memory') THEN ', need ≥2' ELSE '' END
  WHEN title = '' OR coalesce(body, '') = '' THEN CASE kind WHEN 'skill' THEN 'missing slug or draft_skill_md' WHEN 'memory' THEN 'missing slug/body/type'
    WHEN 'rule' THEN 'missing rule or markdown' ELSE 'missing name or fix' END
  WHEN kind = 'memory' AND category NOT IN ('feedback', 'user', 'project', 'reference') THEN 'invalid type: ' || category
  WHEN kind = 'anti_pattern' AND category NOT IN ('rediscovery', 'manual-toil', 'wrong-tool') THEN 'invalid class: ' || category
  END AS reason FROM a_prop p LEFT JOIN sup USING (proposal_id))"""


@query("proposal_support", f"WITH {VALID_SQL} SELECT proposal_id, sessions FROM sup")
def proposal_support(t: Tables) -> DataFrame:
    return P.support(t.a_cite)


_LCP = "len(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: left({0}, i) = left({1}, i)))"

TAGS_SQL = f"""ids AS (SELECT DISTINCT session_id FROM a_msg UNION SELECT DISTINCT session_id || '-' || msg_index FROM a_msg),
near AS (SELECT session_id, lag(session_id) OVER o AS prev, lead(session_id) OVER o AS next FROM ids WINDOW o AS (ORDER BY session_id)),
tags AS (SELECT session_id, left(session_id, greatest(8, 1 + greatest(coalesce({_LCP.format('session_id', 'prev')}, 0),
    coalesce({_LCP.format('session_id', 'next')}, 0)))) AS tag FROM near)"""


def tag_ids(t: Tables) -> DataFrame:
    """Session ids and, so that many share a long start, ids of their messages."""
    own = t.a_msg.select("session_id")
    return own.unionByName(t.a_msg.select(F.concat_ws("-", "session_id", "msg_index").alias("session_id"))).distinct()


@query("session_tags", f"WITH {TAGS_SQL} SELECT session_id, tag FROM tags")
def session_tags(t: Tables) -> DataFrame:
    return identity.session_tags(tag_ids(t))


@query(
    "resolve_tags",
    f"""WITH {TAGS_SQL}, asked AS (SELECT tag FROM tags UNION SELECT left(tag, length(tag) - 1) FROM tags UNION SELECT tag || '?' FROM tags),
    found AS (SELECT a.tag, count(i.session_id) AS n, min(i.session_id) AS first,
        coalesce(bool_or(i.session_id = a.tag), false) AS whole
      FROM (SELECT * FROM asked WHERE tag <> '') a LEFT JOIN ids i ON starts_with(i.session_id, a.tag) GROUP BY a.tag)
    SELECT tag, CASE WHEN n = 1 OR whole THEN first END AS session_id,
      CASE WHEN n = 0 THEN 'unknown' WHEN n = 1 OR whole THEN 'unique' ELSE 'ambiguous' END AS status FROM found""",
)
def resolve_tags(t: Tables) -> DataFrame:
    ids = tag_ids(t)
    tags = identity.session_tags(ids).select("tag")
    shorter, longer = tags.selectExpr("left(tag, length(tag) - 1) AS tag"), tags.selectExpr("tag || '?' AS tag")
    asked = tags.union(shorter).union(longer).filter("tag <> ''").distinct()
    return identity.resolve(asked, ids)


@query(
    "proposal_support_distinct",
    """WITH c AS (SELECT DISTINCT proposal_id, split_part(citation, ':', 1) AS tag FROM a_cite),
    f AS (SELECT proposal_id, tag, count(s.session_id) AS n, min(s.session_id) AS first, coalesce(bool_or(s.session_id = tag), false) AS whole
      FROM c LEFT JOIN (SELECT DISTINCT session_id FROM a_msg) s ON starts_with(s.session_id, tag) WHERE tag <> '' GROUP BY ALL)
    SELECT proposal_id, count(DISTINCT CASE WHEN n = 1 OR whole THEN first END) AS sessions,
      count(DISTINCT CASE WHEN n > 1 AND NOT whole THEN tag END) AS ambiguous, count(DISTINCT CASE WHEN n = 0 THEN tag END) AS unknown
    FROM f GROUP BY proposal_id""",
)
def proposal_support_distinct(t: Tables) -> DataFrame:
    return identity.support(t.a_cite, t.a_msg)


@query(
    "validate_proposals",
    f"""WITH {VALID_SQL} SELECT proposal_id, kind, sessions, coalesce(reason, '') AS reason,
      CASE WHEN reason IS NULL THEN 'accepted' ELSE 'dropped' END AS status FROM val""",
)
def validate_proposals(t: Tables) -> DataFrame:
    out = P.validate(t.a_prop, t.a_cite)
    return out.select("proposal_id", "kind", "sessions", F.coalesce("reason", F.lit("")).alias("reason"), "status")


@query(
    "proposal_outcomes",
    f"""WITH {VALID_SQL} SELECT kind, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'dropped' END AS status,
      coalesce(reason, '') AS reason, count(*) AS proposals FROM val GROUP BY ALL""",
)
def proposal_outcomes(t: Tables) -> DataFrame:
    return P.outcomes(P.validate(t.a_prop, t.a_cite))


@query(
    "proposal_files",
    rf"""WITH {VALID_SQL}, ok AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY proposal_id) AS n FROM val WHERE reason IS NULL)
    SELECT proposal_id, kind, '2024-01-31-' || CASE kind WHEN 'memory' THEN lower(regexp_replace(title, '[^a-zA-Z0-9_-]', '_', 'g'))
      WHEN 'rule' THEN lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INTEGER, '0') || '-' || left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 60)
      ELSE lower(regexp_replace(title, '[^a-zA-Z0-9-]', '-', 'g')) END || '.md' AS file_name,
      regexp_replace(body, '^\s+|\s+$', '', 'g') || chr(10) AS body FROM ok""",
)
def proposal_files(t: Tables) -> DataFrame:
    return P.proposal_files(P.validate(t.a_prop, t.a_cite), "2024-01-31")


# --- skills, usage, posts ---------------------------------------------------


@query(
    "skills_report",
    """SELECT skill_name, count(*) AS uses, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used,
      count(DISTINCT string_split(project_path, '/')[-1]) AS projects FROM a_skill WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY skill_name""",
)
def skills_report(t: Tables) -> DataFrame:
    out = T.skills_report(t.a_skill, datetime(2024, 1, 10))
    return out.withColumn("last_used", stamp("last_used")).orderBy(F.desc("uses"), "skill_name")


@query(
    "skill_projects",
    "SELECT skill_name, string_split(project_path, '/')[-1] AS project, count(*) AS uses FROM a_skill GROUP BY ALL",
)
def skill_projects(t: Tables) -> DataFrame:
    return T.skill_projects(t.a_skill)


@query(
    "dead_skills",
    """SELECT DISTINCT o_orderpriority AS skill_name FROM orders WHERE o_orderpriority NOT IN (SELECT skill_name FROM a_skill)
    UNION SELECT DISTINCT event_type || '2' FROM a_log WHERE event_type || '2' NOT IN (SELECT skill_name FROM a_skill)""",
)
def dead_skills(t: Tables) -> DataFrame:
    known = (
        t.raw("orders").select(F.col("o_orderpriority").alias("skill_name"))
        .union(t.a_log.select(F.concat("event_type", F.lit("2"))))
        .union(t.a_log.select("event_type"))
    )
    return T.dead_skills(known, t.a_skill)


PRICES = [("AF", 0.8e-6, 4e-6), ("NF", 0.1e-6, 0.5e-6), ("NO", 0.8e-6, 4e-6), ("RF", 0.1e-6, 0.5e-6)]
PRICE_SQL = "price(prompt_type, i, o) AS (VALUES " + ", ".join(f"('{p}', {i}::DOUBLE, {o}::DOUBLE)" for p, i, o in PRICES) + ")"


@query(
    "usage_rollup",
    f"""WITH {PRICE_SQL}, c AS (SELECT u.*, prompt_tokens * coalesce(i, 0) + completion_tokens * coalesce(o, 0) AS cost FROM a_usage u LEFT JOIN price USING (prompt_type))
    SELECT coalesce(prompt_type, 'TOTAL') AS prompt_type, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens,
      sum(completion_tokens)::BIGINT AS completion_tokens, sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens,
      floor(sum(prompt_tokens + completion_tokens) / count(*) + 0.5)::BIGINT AS avg_tokens, round(sum(cost), 4) AS cost,
      round(sum(cost) / count(*), 6) AS avg_cost FROM c GROUP BY ROLLUP (prompt_type)""",
)
def usage_rollup(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame(PRICES, "prompt_type string, input_price double, output_price double")
    return T.usage_rollup(t.a_usage, prices)


@query(
    "cache_efficiency",
    """SELECT session_id, sum(input_tokens)::BIGINT AS input_tokens, sum(cache_creation_input_tokens)::BIGINT AS cache_creation_input_tokens,
      sum(cache_read_input_tokens)::BIGINT AS cache_read_input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
      round(sum(cache_read_input_tokens) / sum(input_tokens + cache_creation_input_tokens + cache_read_input_tokens), 6) AS cache_share
    FROM a_usage GROUP BY session_id""",
)
def cache_efficiency(t: Tables) -> DataFrame:
    return T.cache_efficiency(t.a_usage)


SCORE = "coalesce(like_count, 0) + 2 * retweet_count + reply_count"


@query(
    "posts_top",
    f"""SELECT id, text, {SCORE} AS engagement FROM a_post JOIN orders ON o_orderkey = CAST(id AS BIGINT)
    WHERE text NOT LIKE 'RT @%' AND o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY engagement DESC, CAST(id AS BIGINT) LIMIT 15""",
)
def posts_top(t: Tables) -> DataFrame:
    return T.top_posts(t.a_post, since="1997-01-01").select("id", "text", "engagement")


@query(
    "posts_thread",
    """SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY CAST(id AS BIGINT)) - 1 AS pos, id, text
    FROM a_post""",
)
def posts_thread(t: Tables) -> DataFrame:
    return T.threads(t.a_post).select("conversation_id", "pos", "id", "text")


@query(
    "posts_to_messages",
    f"""SELECT 0 AS msg_index, 'user' AS role, '{T.FRAMING.format(label="all posts")}' AS text
    UNION ALL SELECT row_number() OVER (ORDER BY o_orderkey), 'user', '[' || strftime(o_orderdate, '%Y-%m-%d') || '] (' || coalesce(like_count, 0) || '♥ '
      || retweet_count || '🔁 ' || reply_count || '💬) ' || text FROM a_post JOIN orders ON o_orderkey = CAST(id AS BIGINT)""",
)
def posts_to_messages(t: Tables) -> DataFrame:
    posts = t.a_post.withColumn("_id", F.col("id").cast("long"))
    return T.posts_to_messages(posts, ["_id"], F.floor(F.col("_id") / 4096), "all posts")
