from pyspark.sql import functions as F

from skein.operators import search as Q


def brute(text, terms, weights, width):
    words = text.split()
    hits = [[t for t in terms if t in "".join(c if c.isalnum() else " " for c in w.lower()).split()] for w in words]
    best = None
    for i, h in enumerate(hits):
        if h:
            start = max(i - width // 4, 0)
            met = {t for x in hits[start : start + width] for t in x}
            rank = (len(met), round(sum(weights[t] for t in met), 6), -start)
            best = max(best, rank) if best else rank
    if best is None:
        return None
    start = -best[2]
    shown = " ".join(f"[{w}]" if h else w for w, h in zip(words[start : start + width], hits[start : start + width]))
    return ("…" if start else "") + shown + ("…" if start + width < len(words) else "")


def test_best_window(spark):
    weights = {"red": 2.0, "fox": 1.5, "dog": 1.0}
    filler = " ".join(f"w{i}" for i in range(30))
    texts = [
        f"red {filler} fox dog {filler} red fox {filler} red-dog", f"dog {filler} fox {filler} Red!", "none at all", "", "red",
        f"{filler} fox {filler} fox", "dog " * 5000 + f"{filler} red fox dog", f"red red red {filler} dog fox",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "n int, text string")
    got = dict(map(tuple, df.select("n", Q.best_snippet("text", list(weights), weights, 8)).collect()))
    assert got == {i: brute(t, weights, weights, 8) for i, t in enumerate(texts)} | {len(texts): None}


def test_prefix_is_one_term(spark):
    rows = [("a", 0, "author authors red"), ("a", 1, "authentic"), ("b", 0, "red"), ("c", 0, "other")]
    schema = "session_id string, msg_index long, user_text string, assistant_text string, tool_calls string, file_paths string"
    messages = spark.createDataFrame([(*r, "", "", "") for r in rows], schema)
    index = Q.build_index(messages, stem=False)
    merged = messages.withColumn("user_text", F.regexp_replace("user_text", r"\bauth\w*", "auth"))
    want = Q.bm25(Q.build_index(merged, stem=False), ["red", "auth"]).collect()
    got = Q.bm25_prefixes(index, ["red"], ["auth"]).collect()
    assert sorted((*r[:2], round(r[2], 9)) for r in got) == sorted((*r[:2], round(r[2], 9)) for r in want) and len(got) == 3
    positions = Q.with_prefixes(index, [], ["auth"]).postings.filter("session_id = 'a' AND msg_index = 0").first()
    assert positions["term"] == "auth*" and positions["tf_user_text"] == 2 and [p["pos"] for p in positions["positions"]] == [0, 1]
