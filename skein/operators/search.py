"""Ranked, boolean, phrase and field search over an inverted index.

`build_index` yields three tables. `postings` carries the length of its
document, so a query reads only the postings of its terms plus the one-row
corpus table and never joins back to the documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.stem import STEM_TAIL, porter, stem_array, stem_groups
from skein.operators.ordered import chunk_of, top_k
from skein.session import materialise

# Field weights and ranking constants.
WEIGHTS = {"user_text": 8.0, "assistant_text": 3.0, "tool_calls": 1.5, "file_paths": 7.0}
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
SNIPPET_TOKENS = 20
WINDOW_TOKENS = 2000
WINDOW_RADIUS = 40
#: hits, and rows of queries, that meet in one task of a batch (expected numbers)
HIT_ROWS, QUERY_ROWS = 500_000, 200_000

DOC = ("session_id", "msg_index")


class Index(NamedTuple):
    """`postings` has one row per (term, message): `tf_<field>` counts, positions, message length."""

    postings: DataFrame  # term, session_id, msg_index, dl, tf_<field>..., positions ARRAY<STRUCT<field, pos>>
    corpus: DataFrame  # one row: docs, avgdl


def _field_tokens(field: str, stem: bool) -> Column:
    toks = X.tokens(field)
    return stem_array(toks) if stem else toks


def tokenised(messages: DataFrame, fields: Sequence[str] = tuple(WEIGHTS), stem: bool = True) -> DataFrame:
    """Token arrays per field and the document length over all fields."""
    toks = F.struct(*[_field_tokens(f, stem).alias(f) for f in fields])
    # a one-element explode, so that later uses of the arrays do not tokenise again
    arrays = messages.select(*DOC, F.explode(F.array(toks)).alias("t")).select(*DOC, "t.*")
    length = sum((F.size(f) for f in fields[1:]), F.size(fields[0]))
    return arrays.withColumn("dl", length.cast("long"))


def _tagged(field: str) -> Column:
    return F.transform(
        field, lambda t, i: F.struct(F.lit(field).alias("field"), t.alias("term"), i.alias("pos"))
    )


def _starts(term: Column, prefixes: Sequence[str]) -> Column:
    """True for terms that begin with one of the prefixes."""
    return reduce(or_, [F.startswith(term, F.lit(p)) for p in dict.fromkeys(prefixes)], F.lit(False))


def _only(placed: Column, stem: bool, terms: Sequence[str], prefixes: Sequence[str]) -> Column:
    """The placed tokens that are, or stem to, one of `terms` or begin with a prefix.

    Stemming keeps all but the last two letters of a stem from the word, so only
    words that begin with these reach Python.
    """
    wanted = list(dict.fromkeys(terms))
    heads = [t[:-STEM_TAIL] for t in [*wanted, *prefixes]] if stem else prefixes
    likely = F.filter(placed, lambda x: x["term"].isin([] if stem else wanted) | _starts(x["term"], heads))
    if stem:
        stems = stem_array(F.transform(likely, lambda x: x["term"]))
        likely = F.zip_with(likely, stems, lambda x, s: F.struct(x["field"].alias("field"), s.alias("term"), x["pos"].alias("pos")))
        likely = F.filter(likely, lambda x: x["term"].isin(wanted) | _starts(x["term"], prefixes))
    return likely


def build_index(
    messages: DataFrame,
    fields: Sequence[str] = tuple(WEIGHTS),
    stem: bool = True,
    only: Sequence[str] | None = None,
    prefixes: Sequence[str] = (),
) -> Index:
    """Index of all terms, or, for one search over an archive without an index, of those in `only` or with a prefix.

    The latter drops other tokens inside their arrays and is written once, as
    a search reads it for its weights, its scores and the corpus.
    """
    whole = only is None and not prefixes
    docs = tokenised(messages, fields, stem and whole)
    placed = F.flatten(F.array(*[_tagged(f) for f in fields]))
    if not whole:
        slim = docs.select(*DOC, "dl", _only(placed, stem, only or (), prefixes).alias("_at"))
        placed, docs = F.col("_at"), materialise(slim, "search-scan")
    occurrences = docs.select(*DOC, "dl", F.inline(placed))
    # all occurrences of a (term, message) sit in one input row, so this combines before the shuffle
    postings = occurrences.groupBy("term", *DOC, "dl").agg(
        *[F.count_if(F.col("field") == f).alias(f"tf_{f}") for f in fields],
        F.array_sort(F.collect_list(F.struct("field", "pos"))).alias("positions"),
    )
    return Index(postings, docs.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")))


def write_index(index: Index, folder: str, buckets: int = 64) -> None:
    """Store the index; postings are range-sorted by term so a query prunes files and row groups."""
    # the document in the range key lets a frequent term spread over several files
    (
        index.postings.repartitionByRange(buckets, "term", *DOC)
        .sortWithinPartitions("term", *DOC)
        .write.mode("overwrite")
        .parquet(f"{folder}/postings")
    )
    index.corpus.write.mode("overwrite").parquet(f"{folder}/corpus")


def read_index(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/corpus"))


def query_terms(words: Sequence[str], stem: bool = True) -> list[str]:
    """Folded, optionally stemmed, distinct query terms. `words` are single tokens."""
    plain = (
        "".join(ch for ch in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(ch))
        for w in words
    )
    return list(dict.fromkeys(porter(w) if stem else w for w in plain))


def _fields(index: Index) -> list[str]:
    return [c.removeprefix("tf_") for c in index.postings.columns if c.startswith("tf_")]


def _tf(index: Index) -> Column:
    return sum((F.col(f"tf_{f}") for f in _fields(index)[1:]), F.col(f"tf_{_fields(index)[0]}"))


def term_stats(index: Index) -> DataFrame:
    """Messages and occurrences of each term."""
    return index.postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum(_tf(index)).cast("long").alias("occurrences")
    )


def vocabulary(
    messages: DataFrame, fields: Sequence[str] = tuple(WEIGHTS), stem: bool = True
) -> DataFrame:
    """The same statistics straight from messages.

    Each message contributes its distinct terms once for `df` and all its terms
    for `occurrences`, so rows combine by term alone before the shuffle.
    """
    all_terms = F.concat(*fields)
    counted = F.concat(
        F.transform(F.array_distinct(all_terms), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("o"))),
        F.transform(all_terms, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("o"))),
    )
    rows = tokenised(messages, fields, stem).select(F.inline(counted))
    return rows.groupBy("term").agg(F.sum("d").alias("df"), F.sum("o").alias("occurrences"))


def _of_terms(index: Index, terms: Sequence[str]) -> DataFrame:
    return index.postings.filter(F.col("term").isin(list(terms)))


def _weighted(index: Index, weights: Mapping[str, float]) -> Column:
    return sum((F.col(f"tf_{f}") * float(weights.get(f, 0.0)) for f in _fields(index)), F.lit(0.0))


def _idf(docs: Column, df: Column) -> Column:
    return F.greatest(F.log((docs - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def _gain(idf: Column, wtf: Column, dl: Column, avgdl: Column) -> Column:
    return idf * wtf * (K1 + 1) / (wtf + K1 * (1 - B + B * dl / avgdl))


def _term_weights(index: Index, hits: DataFrame) -> DataFrame:
    """`term, idf, avgdl` of the terms in `hits`; the corpus row is read by one scalar subquery."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    corpus = index.corpus.select(F.struct("docs", "avgdl")).scalar()
    return df.withColumn("c", corpus).select(
        "term", _idf(F.col("c.docs"), F.col("df")).alias("idf"), F.col("c.avgdl").alias("avgdl")
    )


def bm25(index: Index, terms: Sequence[str], weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Score of every message that holds a query term; larger is better.

    Changing `weights` needs no new index.
    """
    hits = _of_terms(index, terms)
    # one row per query term, so the size is bounded by the query itself
    idf = F.broadcast(_term_weights(index, hits))
    scored = hits.select("term", *DOC, "dl", _weighted(index, weights).alias("wtf")).join(idf, "term")
    gain = _gain(F.col("idf"), F.col("wtf"), F.col("dl"), F.col("avgdl"))
    return scored.groupBy(*DOC).agg(F.sum(gain).alias("score"))


def bm25_scan(
    messages: DataFrame, terms: Sequence[str], weights: Mapping[str, float] = WEIGHTS, stem: bool = True
) -> DataFrame:
    """The same scores straight from messages, for archives without a stored index.

    Tokens other than the query terms are dropped inside their array, before
    anything is exploded or shuffled.
    """
    return bm25(build_index(messages, tuple(weights), stem, only=terms), terms, weights)


def with_prefixes(index: Index, terms: Sequence[str], prefixes: Sequence[str]) -> Index:
    """The index of `terms` and of the prefixes, each as one term `prefix*` that stands for all terms it starts.

    Postings are sorted by term, so a prefix reads one range of them.
    """
    postings = _of_terms(index, terms)
    for prefix in dict.fromkeys(prefixes):
        some = index.postings.filter(F.startswith("term", F.lit(prefix)))
        counts = [F.sum(f"tf_{f}").alias(f"tf_{f}") for f in _fields(index)]
        together = some.groupBy(F.lit(f"{prefix}*").alias("term"), *DOC, "dl").agg(
            *counts, F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")
        )
        postings = postings.unionByName(together.select(postings.columns))
    return Index(postings, index.corpus)


def bm25_prefixes(
    index: Index, terms: Sequence[str], prefixes: Sequence[str], weights: Mapping[str, float] = WEIGHTS
) -> DataFrame:
    """Scores over terms and prefixes; a prefix weighs by the messages that hold any of its terms."""
    return bm25(with_prefixes(index, terms, prefixes), [*terms, *(f"{p}*" for p in prefixes)], weights)


def search_sessions(
    index: Index,
    sessions: DataFrame,
    terms: Sequence[str],
    limit: int = 10,
    sources: Sequence[str] | None = None,
    weights: Mapping[str, float] = WEIGHTS,
) -> DataFrame:
    """Best message of each session with session metadata, best sessions first."""
    return best_sessions(bm25(index, terms, weights), sessions, limit, sources)


def best_sessions(
    scores: DataFrame, sessions: DataFrame, limit: int = 10, sources: Sequence[str] | None = None
) -> DataFrame:
    best = scores.withColumn("score", F.round("score", 6)).groupBy("session_id").agg(
        F.max("score").alias("score"),
        F.max_by("msg_index", F.struct("score", -F.col("msg_index"))).alias("best_msg_index"),
    )
    meta = sessions if sources is None else sessions.filter(F.col("source").isin(list(sources)))
    return best.join(meta, "session_id").orderBy(F.desc("score"), "session_id").limit(limit)


def search_batch(
    index: Index,
    queries: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    k: int = 10,
    hit_rows: int = HIT_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Many queries at once: `queries(query_id, term)` to the top `k` sessions of each.

    Blocks of messages meet blocks of queries, each of a bounded number of rows;
    scores of (query, message) pairs stay inside the task, which returns the best
    `k` sessions of its messages for each query. A session of the overall best
    `k` is among those of the block that holds its best message, so none is lost.
    """
    wanted = materialise(queries.select("query_id", "term").distinct(), "batch-queries")
    hits = index.postings.join(wanted.select("term").distinct(), "term", "left_semi").select(
        "term", *DOC, "dl", _weighted(index, weights).alias("wtf")
    )
    hits = materialise(hits, "batch-hits")
    blocks, groups = (max(1, -(-df.count() // rows)) for df, rows in ((hits, hit_rows), (wanted, query_rows)))
    gain = _gain(F.col("idf"), F.col("wtf"), F.col("dl"), F.col("avgdl"))
    scored = hits.join(_term_weights(index, hits), "term").select("term", *DOC, gain.alias("gain"))
    block = F.pmod(F.xxhash64(*DOC), F.lit(blocks)).alias("block")
    left = scored.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    right = wanted.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )

    def run(some: pa.Table, asked: pa.Table) -> pa.Table:
        return block_best(some, asked, k)

    kinds = {f.name: f.dataType.simpleString() for f in (*hits.schema, *wanted.schema)}
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        run, f"query_id {kinds['query_id']}, session_id {kinds['session_id']}, msg_index {kinds['msg_index']}, score double"
    )
    best = met.groupBy("query_id", "session_id").agg(
        F.max("score").alias("score"),
        F.max_by("msg_index", F.struct("score", -F.col("msg_index"))).alias("best_msg_index"),
    )
    return top_k(best, ["query_id"], [F.desc("score"), F.col("session_id")], k, "rank")


def rounded(scores: np.ndarray) -> np.ndarray:
    """Six decimals, half up on the shortest decimal form, as Spark's `round`."""
    scaled = scores * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(scores[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def block_best(hits: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best `k` sessions of `hits(term, session_id, msg_index, gain)` for each query of `asked(query_id, term)`.

    Every hit of a query's terms is added up; only then the messages that score
    at least as well as the best few dozen are told apart by session.
    """
    terms = asked["term"].unique()
    term = pc.index_in(hits["term"], value_set=terms)
    hits = hits.append_column("t", term).filter(pc.is_valid(term))
    names = sorted(hits["session_id"].unique().to_pylist(), key=lambda s: (s is not None, s or ""))
    session = pc.index_in(hits["session_id"], value_set=pa.array(names, hits.schema.field("session_id").type)).to_numpy()
    order = np.lexsort((hits["msg_index"].to_numpy(), session))
    session, position = session[order], hits["msg_index"].to_numpy()[order]
    new = np.ones(len(order), bool)
    new[1:] = (session[1:] != session[:-1]) | (position[1:] != position[:-1])
    # messages are numbered by session and position, so smaller numbers win ties
    doc = np.cumsum(new) - 1
    session, position = session[new], position[new]
    term, gain = hits["t"].to_numpy()[order], hits["gain"].to_numpy()[order]
    order = np.argsort(term, kind="stable")
    doc, gain, starts = doc[order], gain[order], np.searchsorted(term[order], np.arange(len(terms) + 1))
    total = np.zeros(len(session))

    of_query: dict[object, list[int]] = {}
    for q, t in zip(asked["query_id"].to_pylist(), pc.index_in(asked["term"], value_set=terms).to_pylist(), strict=True):
        of_query.setdefault(q, []).append(t)
    found: list[tuple[object, np.ndarray, np.ndarray]] = []
    for q, ts in of_query.items():
        spans = [slice(starts[t], starts[t + 1]) for t in sorted(ts)]
        docs = np.concatenate([doc[s] for s in spans])
        for s in spans:
            total[doc[s]] += gain[s]
        scores = total[docs]
        total[docs] = 0
        first = 32 * k
        while len(docs):
            least = np.partition(scores, -first)[-first] if first < len(docs) else -np.inf
            near = scores >= least - 2e-6
            some, at = np.unique(docs[near], return_index=True)
            value = rounded(scores[near][at])
            order = np.lexsort((some, -value))
            _, at = np.unique(session[some[order]], return_index=True)
            top = order[np.sort(at)[:k]]
            # what was left out rounds to less than this
            if first >= len(docs) or np.count_nonzero(value[top] >= least - 1e-6) == k:
                found.append((q, some[top], value[top]))
                break
            first *= 8
    docs = np.concatenate([np.zeros(0, np.int64), *(d for _, d, _ in found)])
    return pa.table({
        "query_id": pa.array([q for q, d, _ in found for _ in d], asked.schema.field("query_id").type),
        "session_id": pa.array([names[s] for s in session[docs]], hits.schema.field("session_id").type),
        "msg_index": pa.array(position[docs], hits.schema.field("msg_index").type),
        "score": np.concatenate([np.zeros(0), *(v for _, _, v in found)]),
    })


def match_boolean(
    index: Index,
    all_of: Sequence[str] = (),
    any_of: Sequence[str] = (),
    none_of: Sequence[str] = (),
) -> DataFrame:
    """Documents by term presence, in one pass over the postings of the named terms."""
    if not (all_of or any_of):
        raise ValueError("a search needs a required or an optional term")

    def present(terms: Sequence[str]) -> Column:
        return F.count_if(F.col("term").isin(list(terms))) if terms else F.lit(0)

    cond = (F.col("n_all") == len(set(all_of))) & (F.col("n_none") == 0)
    if any_of:
        cond = cond & (F.col("n_any") > 0)
    got = _of_terms(index, [*all_of, *any_of, *none_of]).groupBy(*DOC).agg(
        present(all_of).alias("n_all"), present(any_of).alias("n_any"), present(none_of).alias("n_none")
    )
    return got.filter(cond).select(*DOC)


def match_phrase(index: Index, phrase: Sequence[str]) -> DataFrame:
    """Documents and fields holding the words one after another, with the number of places.

    Positions are shifted by the word's place in the phrase, so a phrase starts
    where every word agrees; no pairs of postings are formed.
    """
    places = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(phrase)])
    hits = _of_terms(index, phrase).select(*DOC, "term", F.inline("positions"))
    starts = hits.select("*", F.explode(places).alias("p")).filter(F.col("p.w") == F.col("term")).select(
        *DOC, "field", (F.col("pos") - F.col("p.i")).alias("start")
    )
    full = starts.groupBy(*DOC, "field", "start").agg(F.count("*").alias("n")).filter(
        F.col("n") == len(phrase)
    )
    return full.groupBy(*DOC, "field").agg(F.count("*").alias("places"))


def match_field(index: Index, field: str, terms: Sequence[str]) -> DataFrame:
    """Documents that hold every term in one field."""
    tf = F.col(f"tf_{field}")
    return (
        _of_terms(index, terms)
        .filter(tf > 0)
        .groupBy(*DOC)
        .agg(F.count("*").alias("n"), F.sum(tf).cast("long").alias("occurrences"))
        .filter(F.col("n") == len(set(terms)))
        .select(*DOC, "occurrences")
    )


def hit_context(
    found: DataFrame, messages: DataFrame, terms: Sequence[str], text: str = "text", stem: bool = True
) -> DataFrame:
    """Add the time and a snippet of the best message to the rows of a session search.

    `found` has `best_msg_index` and as many rows as the search's limit, so only
    those messages are cut.
    """
    best = messages.select("session_id", F.col("msg_index").alias("best_msg_index"), F.col("ts").alias("best_ts"), text)
    joined = found.join(best, ["session_id", "best_msg_index"], "left")
    return joined.withColumn("snippet", snippet(text, terms, stem=stem)).drop(text)


def snippet(text: str | Column, terms: Sequence[str], width: int = SNIPPET_TOKENS, stem: bool = False) -> Column:
    """Up to `width` words from a quarter width before the first hit, hits in brackets.

    Words are the text split at whitespace; a word is a hit when its folded
    letters and digits contain a term as a token, stemmed first with `stem` as
    in a stemmed index. Null without a hit.
    """
    col = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(col, r"\s+"), lambda w: w != "")
    wanted = F.array(*[F.lit(t) for t in terms])
    if stem:
        stems = stem_groups(F.transform(words, X.tokens))
        flagged = F.zip_with(
            words, stems, lambda w, s: F.struct(w.alias("w"), F.arrays_overlap(s, wanted).alias("hit"))
        )
    else:
        flagged = F.transform(
            words, lambda w: F.struct(w.alias("w"), F.arrays_overlap(X.tokens(w), wanted).alias("hit"))
        )
    first = F.array_position(F.transform(flagged, lambda s: s["hit"]), F.lit(True)).cast("int")
    start = F.greatest(first - width // 4, F.lit(1))
    cut = F.slice(flagged, start, F.lit(width))
    body = F.array_join(
        F.transform(cut, lambda s: F.when(s["hit"], F.concat(F.lit("["), s["w"], F.lit("]"))).otherwise(s["w"])),
        " ",
    )
    lead = F.when(start > 1, F.lit("…")).otherwise("")
    tail = F.when(start + width - 1 < F.size(words), F.lit("…")).otherwise("")
    return F.when(first > 0, F.concat(lead, body, tail))


def best_snippet(
    text: str | Column, terms: Sequence[str], weights: Mapping[str, float] | None = None, width: int = SNIPPET_TOKENS
) -> Column:
    """The window of `width` words with most distinct terms, then the largest sum of their weights, then the first.

    Windows start a quarter width before each hit, and each looks at its own
    words only, so the cost grows with hits, not with pairs of them. Hits are in
    brackets; null without a hit.
    """
    col = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(col, r"\s+"), lambda w: w != "")
    wanted = F.array(*[F.lit(t) for t in terms])
    weight = F.create_map(*[F.lit(x) for t in terms for x in (t, float((weights or {}).get(t, 1.0)))])
    flagged = F.transform(words, lambda w: F.struct(w.alias("w"), F.array_intersect(X.tokens(w), wanted).alias("terms")))
    # a one-element transform evaluates the tokens once
    state = F.array(F.struct(flagged.alias("f")))

    def window(f: Column, start: Column) -> Column:
        return F.slice(f, start, F.lit(width))

    def score(f: Column, start: Column) -> Column:
        met = F.array_distinct(F.flatten(F.transform(window(f, start), lambda s: s["terms"])))
        total = F.aggregate(met, F.lit(0.0), lambda a, t: a + weight[t])
        return F.struct(F.size(met).alias("n"), F.round(total, 6).alias("weight"), (-start).alias("start"))

    def best(s: Column) -> Column:
        places = F.filter(F.transform(s["f"], lambda x, i: F.when(F.size(x["terms"]) > 0, i + 1)), lambda i: i.isNotNull())
        top = F.array_max(F.transform(places, lambda i: score(s["f"], F.greatest(i - width // 4, F.lit(1)))))
        return F.struct(s["f"].alias("f"), (-top["start"]).alias("start"))

    def shown(s: Column) -> Column:
        body = F.array_join(
            F.transform(window(s["f"], s["start"]), lambda x: F.when(F.size(x["terms"]) > 0, F.concat(F.lit("["), x["w"], F.lit("]"))).otherwise(x["w"])),
            " ",
        )
        lead = F.when(s["start"] > 1, F.lit("…")).otherwise("")
        tail = F.when(s["start"] + width - 1 < F.size(s["f"]), F.lit("…")).otherwise("")
        return F.when(s["start"].isNotNull(), F.concat(lead, body, tail))

    return F.transform(F.transform(state, best), shown)[0]


def read_windows(
    messages: DataFrame,
    requests: DataFrame,
    max_tokens: int = WINDOW_TOKENS,
    radius: int = WINDOW_RADIUS,
    chunk: int | None = None,
) -> DataFrame:
    """Token-bounded windows around `requests(request_id, session_id, target)`.

    The centre comes first, then right and left neighbours by turns, until the
    budget is spent; the text of the last one is cut to fit. Requests meet
    messages on (session, chunk), so a long session spreads over many tasks,
    and each window ranks at most `2 * radius + 1` rows.
    """
    # a chunk as wide as a window keeps candidates within three windows per request
    chunk = chunk or 2 * radius + 1
    budget = max_tokens * X.CHARS_PER_TOKEN
    lo, hi = F.greatest(F.col("target") - radius, F.lit(0)), F.col("target") + radius
    spread = requests.select(
        "request_id", "session_id", "target",
        F.explode(F.sequence(chunk_of(lo, chunk), chunk_of(hi, chunk))).alias("_chunk"),
    )
    near = (
        messages.withColumn("_chunk", chunk_of("msg_index", chunk))
        .join(spread, ["session_id", "_chunk"])
        .filter(F.col("msg_index").between(lo, hi))
    )
    req = Window.partitionBy("request_id")
    first = F.min("msg_index").over(req)
    centre = F.coalesce(
        F.min(F.when(F.col("msg_index") >= F.col("target"), F.col("msg_index"))).over(req), first
    )
    text = F.when(F.col("user_text") != "", F.col("user_text")).otherwise(F.col("assistant_text"))
    by_pos = req.orderBy("msg_index")
    ranked = near.select(
        "request_id", "session_id", "msg_index", "ts",
        F.when(F.col("user_text") != "", "user").otherwise("assistant").alias("role"),
        text.alias("text"), "tool_calls", "file_paths",
        F.row_number().over(by_pos).alias("_rn"),
        centre.alias("_centre"),
    ).withColumn(
        "_mid", F.max(F.when(F.col("msg_index") == F.col("_centre"), F.col("_rn"))).over(req)
    )
    dist = F.col("_rn") - F.col("_mid")
    size = F.count("*").over(req)
    right, left = size - F.col("_mid"), F.col("_mid") - 1
    # right d comes before left d; once a side is used up the other side runs on alone
    turn = F.when(dist > 0, dist + F.least(dist - 1, left)).otherwise(-dist + F.least(-dist, right))
    spent = F.sum(F.length("text") + F.length("tool_calls")).over(
        req.orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    )
    taken = ranked.withColumn("_turn", turn).withColumn(
        "_left", F.lit(budget) - F.coalesce(spent, F.lit(0))
    )
    return taken.filter((F.col("_turn") == 0) | (F.col("_left") > 0)).select(
        "request_id", "session_id", "msg_index", "ts", "role",
        F.left("text", F.greatest(F.col("_left"), F.lit(0)).cast("int")).alias("text"),
        "tool_calls", "file_paths",
    )
