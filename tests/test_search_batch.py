"""Many searches at once, block by block, against a plain pass over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import search

FIELDS = ("user_text", "assistant_text", "tool_calls", "file_paths")


def plain(messages, queries, k):
    """{query: [(rank, session, message, score)]}."""
    tokens = [(s, i, Counter(user.split()), len(user.split())) for s, i, user in messages]
    average, df = sum(t[3] for t in tokens) / len(tokens), Counter(w for t in tokens for w in t[2])
    out = {}
    for q in {q for q, _ in queries}:
        best = {}
        for s, i, counts, dl in tokens:
            score, hit = 0.0, False
            for w in {w for p, w in queries if p == q} & set(counts):
                idf = max(math.log((len(tokens) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6)
                wtf, hit = 8.0 * counts[w], True
                score += idf * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * dl / average))
            if hit:
                best[s] = min(best.get(s, (0, 0)), (-round(score, 6), i))
        ranked = sorted((score, s, i) for s, (score, i) in best.items())[:k]
        if ranked:
            out[q] = [(n + 1, s, i, -score) for n, (score, s, i) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("hit_rows, query_rows", [(40, 7), (500_000, 200_000)])
def test_blocks_lose_no_session(spark, hit_rows, query_rows):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    messages = [(f"s{rng.randrange(12)}" if n % 3 else "hot", n, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for n in range(160)]
    messages += [("hot", 200 + n, messages[0][2]) for n in range(150)] + [(f"t{n}", 1, messages[0][2]) for n in range(5)]
    queries = [(q, w) for q in range(20) for w in rng.sample([*words, "absent"], 3)] + [(3, "w1"), (90, "absent")]
    rows = spark.createDataFrame(messages, "session_id string, msg_index int, user_text string")
    rows = rows.select("*", *[F.lit("").alias(f) for f in FIELDS[1:]])
    asked = spark.createDataFrame(queries, "query_id long, term string")
    got = {}
    found = search.search_batch(search.build_index(rows, stem=False), asked, k=3, hit_rows=hit_rows, query_rows=query_rows)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["session_id"], r["best_msg_index"], r["score"]))
    assert got == plain(messages, queries, 3)


def test_rounding_is_that_of_spark(spark):
    values = np.array([0.0, 1.0000005, 2.0000015, 0.1234565, 7.1234564999, 12.3456785, 1e-7, 5e-7, 33.3333335])
    want = [r["x"] for r in spark.createDataFrame([(float(v),) for v in values], "x double").select(F.round("x", 6).alias("x")).collect()]
    assert search.rounded(values).tolist() == want
