"""Bucketed order operators against plain Python, with keys far longer than a bucket."""

import random

from pyspark.sql import functions as F

from skein.operators import digest as D
from skein.operators import learnings as E
from skein.operators import ordered as O
from skein.operators import search as Q
from skein.operators import signals as G
from skein.operators import timeline as L
from skein.operators.ordered import chunk_of, neighbours, ordinal, running_sums


def test_running_sums_and_ordinal(spark):
    rng = random.Random(1)
    data = [("hot", i * 3, rng.randint(-5, 5)) for i in range(500)] + [(f"k{i % 7}", i, i) for i in range(60)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, pos long, v long")
    got = ordinal(running_sums(df, ["k"], ["pos"], chunk_of("pos", 16), {"s": F.col("v")}), ["k"], ["pos"], chunk_of("pos", 16), "n")
    expected = {}
    for key in {d[0] for d in data}:
        total = 0
        for n, (_, pos, v) in enumerate(sorted(d for d in data if d[0] == key)):
            total += v
            expected[key, pos] = (total, n)
    assert {(r.k, r.pos): (r.s, r.n) for r in got.collect()} == expected


def test_neighbours_cross_chunk_edges(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)], "k string, pos long")
    got = neighbours(
        df, ["k"], "pos",
        {"p": lambda w: F.lag("pos").over(w), "n": lambda w: F.lead("pos", 2).over(w)}, before=1, after=2, size=8,
    ).collect()
    assert len(got) == 100
    for r in got:
        assert r.p == (r.pos - 1 if r.pos else None)
        assert r.n == (r.pos + 2 if r.pos < 98 else None)


def greedy(anchors, n):
    kept, used = [], set()
    for a in anchors:
        window = range(max(0, a - 4), min(n - 1, a + 15) + 1)
        if sum(i in used for i in window) > len(window) * 0.5:
            continue
        used.update(window)
        kept.append(a)
    return kept


def test_episodes_match_the_sequential_pass(spark):
    rng = random.Random(7)
    sizes = {f"s{i}": rng.choice([1, 5, 19, 20, 21, 40, 90, 400, 1500]) for i in range(40)}
    rows, expected = [], {}
    for sid, n in sizes.items():
        density = rng.choice([0.02, 0.2, 0.7, 1.0])
        picks = [i for i in range(n) if rng.random() < density]
        if sid in ("s1", "s2"):  # long silent stretch between dense parts
            picks = [i for i in picks if not n // 3 < i < n // 3 * 2]
        expected[sid] = greedy(picks, n)
        marked = set(picks)
        rows += [(sid, i, "tool_failure" if i in marked else None) for i in range(n)]
    flagged = spark.createDataFrame(rows, "session_id string, pos long, signal string").cache()
    for size, fan in ((24, 2), (32, 5), (1024, 1024)):
        got = {sid: [] for sid in sizes}
        for r in G.select_episodes(flagged, size, fan).orderBy("session_id", "anchor").collect():
            got[r.session_id].append(r.anchor)
            assert (r.start, r.end) == (max(0, r.anchor - 4), min(sizes[r.session_id] - 1, r.anchor + 15))
        assert got == expected, (size, fan)


def test_importance_floor_applies_at_every_step(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for i in range(30):
        x = 10
        for t in range(rng.randint(1, 80)):
            useful = rng.random() < rng.choice([0.2, 0.5, 0.8])
            x = max(3, x + (1 if useful else -1))
            rows.append((f"l{i}", t, useful))
        expected[f"l{i}"] = round(x * 0.1, 6)
    df = spark.createDataFrame(rows, "id string, t long, useful boolean")
    got = {r.id: r.importance for r in E.importance(df, chunk_of("t", 8), ["t"]).collect()}
    assert got == expected


def test_review_status_fold(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for i in range(60):
        status, at = "local", None
        for t in range(rng.randint(1, 12)):
            act = rng.choices(["share", "private", "edit-tags", "skip", "delete"], [3, 3, 4, 3, 0.3])[0]
            rows.append((f"l{i}", t, act))
            if status == "gone":
                continue
            if act == "delete":
                status = "gone"
            elif act in ("share", "private"):
                status, at = ("reviewed" if act == "share" else "private"), t
            elif act == "edit-tags" and status != "private":
                status, at = "local", None
        if status != "gone":
            expected[f"l{i}"] = (status, at)
    df = spark.createDataFrame(rows, "id string, at long, action string")
    assert {r.id: (r.share_status, r.reviewed_at) for r in E.review_status(df).collect()} == expected


def walk_window(lengths, target, budget, radius):
    """Centre, then right and left by turns, until the budget is spent."""
    near = [i for i in range(len(lengths)) if max(0, target - radius) <= i <= target + radius]
    if not near:
        return {}
    start = next((p for p, i in enumerate(near) if i >= target), 0)
    out, left, right = {}, start - 1, start + 1

    def take(p):
        nonlocal budget
        i = near[p]
        out[i] = max(0, min(lengths[i], budget))
        budget -= out[i]

    take(start)
    while budget > 0 and (left >= 0 or right < len(near)):
        if right < len(near):
            take(right)
            right += 1
            if budget <= 0:
                break
        if left >= 0:
            take(left)
            left -= 1
    return out


def test_read_windows(spark):
    rng = random.Random(11)
    sessions = {f"s{i}": [rng.randint(1, 60) for _ in range(rng.choice([1, 3, 30, 200]))] for i in range(12)}
    messages = [(s, i, "x" * n if i % 2 else "", "" if i % 2 else "x" * n, "", "") for s, ls in sessions.items() for i, n in enumerate(ls)]
    df = spark.createDataFrame(messages, "session_id string, msg_index long, user_text string, assistant_text string, tool_calls string, file_paths string").withColumn("ts", F.lit(None).cast("timestamp"))
    asks = [(f"{s}-{t}", s, t) for s, ls in sessions.items() for t in {0, len(ls) // 2, len(ls) - 1, len(ls) + 2}]
    requests = spark.createDataFrame(asks, "request_id string, session_id string, target long")
    got = {}
    for r in Q.read_windows(df, requests, max_tokens=60, radius=9, chunk=16).collect():
        got.setdefault(r.request_id, {})[r.msg_index] = len(r.text)
    for rid, s, t in asks:
        assert got.get(rid, {}) == walk_window(sessions[s], t, 240, 9), rid


def test_turns_follow_the_reading_rules(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for s in range(15):
        seq = [(rng.choice(["user", "assistant", "assistant", "system"]), rng.random() < 0.4, rng.random() < 0.3) for _ in range(rng.choice([1, 4, 60]))]
        seq = [(role, echo and role == "user", is_meta and role == "user") for role, echo, is_meta in seq]
        groups, i = [], 0
        while i < len(seq):
            role, echo, is_meta = seq[i]
            if role == "user" and (echo or is_meta):
                i += 1
                continue
            members, j = [i], i + 1
            if role == "user":
                while j < len(seq) and seq[j][0] == "user" and not seq[j][1]:
                    members.append(j)
                    j += 1
            elif role == "assistant":
                while j < len(seq) and (seq[j][0] == "assistant" or seq[j][1]):
                    if seq[j][0] == "assistant":
                        members.append(j)
                    j += 1
            groups.append((role, tuple(members)))
            i = j
        expected[f"s{s}"] = sorted(groups, key=lambda g: g[1])
        rows += [(f"s{s}", p, role, "t", echo, is_meta) for p, (role, echo, is_meta) in enumerate(seq)]
    df = spark.createDataFrame(rows, "session_id string, pos long, role string, text string, is_echo boolean, is_meta boolean")
    got = {}
    for r in L.assign_turns(df).collect():
        got.setdefault(r.session_id, {}).setdefault(r.turn_no, []).append((r.pos, r.role))
    shaped = {
        s: sorted(((m[0][1], tuple(sorted(p for p, _ in m))) for m in turns.values()), key=lambda g: g[1])
        for s, turns in got.items()
    }
    assert shaped == {s: g for s, g in expected.items() if g}


def test_prior_windows(spark):
    rng = random.Random(9)
    spans = []
    for i in range(80):
        start = rng.randint(0, 4000) * 3600
        spans.append((f"w{i:02d}", start, start + rng.randint(1, 300) * 3600))
    df = spark.createDataFrame(spans, "name string, s long, e long").select(
        "name", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end")
    )
    got = {r.name: r.prior_name for r in D.prior_windows(df).collect()}
    for name, start, _ in spans:
        before = [(e, n) for n, _, e in spans if e < start]
        assert got[name] == (max(before)[1] if before else None)


def test_prior_windows_without_start_or_end(spark):
    df = spark.sql(
        """SELECT * FROM VALUES ('a', timestamp'2020-01-01', timestamp'2020-01-02'), ('b', null, timestamp'2020-01-05'),
        ('c', timestamp'2020-01-03', null), ('d', timestamp'2020-01-09', timestamp'2020-01-10'), ('e', null, null) AS t(name, start, end)"""
    )
    assert {r.name: r.prior_name for r in D.prior_windows(df).collect()} == {"a": None, "b": None, "c": "a", "d": "b", "e": None}
    assert D.prior_windows(df.limit(0)).count() == 0


def test_ranges_are_even_over_any_spread(spark):
    # most instants in one day, the rest over 300 years
    at = F.when(F.col("id") % 10 != 0, F.col("id")).otherwise((F.col("id") - 100_000) * 100_000)
    rows = spark.range(200_000).select(at.alias("at"), F.when(F.xxhash64("id") % 1000 == 0, F.struct("id")).alias("v"))
    fold = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(fold)
    spark.conf.set(fold, "false")
    try:
        sizes = [r["count"] for r in O.ranges_filled(rows, ["at"], "v").groupBy("_range").count().collect()]
        got = {r["at"]: r["p"] and r["p"]["id"] for r in O.last_before(rows, ["at"], "v", "p").collect()}
    finally:
        spark.conf.set(fold, before)
    assert len(sizes) > 1 and max(sizes) < 2 * sum(sizes) / len(sizes)
    last, count = None, 0
    for r in sorted(rows.collect(), key=lambda r: r["at"]):
        assert got[r["at"]] == last
        last, count = (r["v"]["id"] if r["v"] else last), count + 1
    assert count == len(got) == 200_000
