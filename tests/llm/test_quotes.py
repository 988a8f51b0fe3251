import random

from skein.llm import quotes


def messages(spark, rows):
    return spark.createDataFrame([(c, t, x, "clash") for c, t, x in rows], "conv_id long, turn long, text string, hash string")


def brute(rows):
    """{(conv, turn): (parent, root, depth, linked, own text)} by looking at every earlier message."""
    said = {}
    for c, t, x in rows:
        if c is not None and t is not None:
            said[c, t] = min(x or "", said.get((c, t), x or ""))
    lines = {k: quotes.parse(x) for k, x in said.items()}
    parents, linked = {}, {}
    for (c, t), (_, _, quoted) in lines.items():
        found = []
        for level, mark in quoted:
            near = [k for k in lines if k[0] == c and k[1] < t and mark in lines[k][1]]
            every = [k for k in lines if mark in lines[k][1]]
            to = max(near) if near else min(every) if every and min(every)[0] < c else None
            if to:
                found.append((-level, to))
        linked[c, t] = len(found)
        parents[c, t] = max(found)[1] if found else None
    out = {}
    for k in lines:
        depth, at = 0, k
        while parents[at]:
            at, depth = parents[at], depth + 1
        out[k] = (parents[k], at, depth, linked[k], lines[k][0])
    return out


def compare(spark, rows):
    got = quotes.conversations(messages(spark, rows)).collect()
    want = brute(rows)
    whole = [r for r in got if r["conv_id"] is not None and r["turn"] is not None]
    assert len(whole) == len(want)
    by_root = {}
    for r in whole:
        parent = (r["parent_conv"], r["parent_turn"]) if r["parent_turn"] is not None else None
        root = (r["root_conv"], r["root_turn"])
        assert (parent, root, r["depth"], r["n_linked"], r["own_text"]) == want[r["conv_id"], r["turn"]]
        by_root.setdefault(root, []).append((r["position"], (r["conv_id"], r["turn"]), parent))
    for own in by_root.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        seen = set()
        for _, me, parent in own:
            assert parent is None or parent in seen
            seen.add(me)
    return got


def test_levels_and_lines():
    assert quotes.level_of("> > deep") == (2, "deep") == quotes.level_of(">> deep")
    assert quotes.level_of("a > b") == (0, "a > b")
    text, written, quoted = quotes.parse("> > One, two\n> three\n>\nmine\n\n  !?\nmine")
    assert text == "mine\n\n  !?\nmine" and len(written) == 1
    assert quoted == [(2, quotes.line_hash("one TWO")), (1, quotes.line_hash("Three"))]


def test_random_threads_match_brute_force(spark):
    rng = random.Random(9)
    lines = [f"line number {i} of some talk" for i in range(30)] + ["thanks", "regards"]
    rows = []
    for c in range(12):
        said = []
        for t in range(rng.randrange(1, 9)):
            body = [f"{'> ' * rng.randrange(1, 4)}{rng.choice(said or lines)}" for _ in range(rng.randrange(3))]
            own = [rng.choice(lines) for _ in range(rng.randrange(1, 3))]
            said += own
            rows.append((c, t, "\n".join([*body, *own])))
    compare(spark, rows)


def test_long_chain_and_common_line(spark):
    rows = [(1, 0, "start\nthanks")]
    for t in range(1, 2500):
        rows.append((1, t, f"> answer {t - 1}\n> thanks\nanswer {t}\nthanks" if t > 1 else "> start\nanswer 1\nthanks"))
    got = quotes.conversations(messages(spark, rows)).collect()
    assert max(r["depth"] for r in got) == 2499 and {(r["root_conv"], r["root_turn"]) for r in got} == {(1, 0)}
    assert sorted(r["position"] for r in got) == list(range(2500))


def test_awkward_rows(spark):
    rows = [(1, 0, "hello there"), (1, 0, "hello there"), (1, 1, None), (1, 2, ""), (2, 5, "> hello there\nyes"), (None, 1, "> hello there"), (3, None, "x"), (4, 0, "> unknown\nz"), (0, 0, "> yes\nfirst")]
    got = compare(spark, rows)
    odd = [r for r in got if r["conv_id"] is None or r["turn"] is None]
    assert len(odd) == 2 and all(r["depth"] == 0 and r["n_linked"] == 0 for r in odd)
    assert quotes.conversations(messages(spark, rows).filter("turn > 100")).count() == 0


def test_query_over_the_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    mail = [(r["conv_id"], r["turn"], r["text"]) for r in quotes.as_mail(turns).collect()]
    assert len(mail) == turns.count()
    got = compare(spark, mail)
    assert any(r["depth"] > 1 for r in got)
