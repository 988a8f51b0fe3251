import random
import zlib
from hashlib import sha256

import pytest

from skein.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, n int, owner string, rank int, parent string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "?", 1, "?", 2, "?") for r in rows], SCHEMA)


def words(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return sum(1 for w in text.split(" ") if w)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [t for *_, t in sorted(ts)] for c, ts in convs.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = own.get(base, [])[:h] + ts[h:]
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = (1, 0) if p not in children else (0, 0)
        for q in children.get(p, ()):
            leaves, saved = leaves + totals[q][0], saved + totals[q][1]
        totals[p] = leaves, saved + ((len(members[p]) - 1) * words(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(children.get(p, ())), *totals[p], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    got = sorted(map(tuple, trie.prefixes(table(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    return got


def random_rows(seed, convs, longest, alphabet):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(longest + 1)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choices(alphabet, k=rng.randrange(3)))))
    return rows


def test_random_conversations(spark):
    check(spark, random_rows(1, 120, 9, ["a"]))


def test_chains_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(trie, "FAN", 2)
    monkeypatch.setattr(trie, "BLOCK", 2)
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = random_rows(2, 40, 5, ["a", "b"])
    for c in range(100, 112):  # two long paths, cut at different places, with late forks
        rows += [(c, t, "user", f"x y{t}") for t in range(30 + c % 4)] + [(c, 99, "user", f"end {c % 3}")] * (c % 2)
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, "user", "first"), (0, 0, None, None), (0, 0, "user", "tie b"), (0, 0, "user", "tie a"),
        (0, 3, "user", "word " * 200_000), (1, 0, "user", "a\tb\x0bc d e"), (1, 0, "user", "a\tb\x0bc d e"), (5, 0, "", ""),
        (-3, 1, "user", "negative"), (25, 7, "user", "no base"), (26, 0, "user", "no base"), (26, 1, "user", "no base"), (2**60, 0, "u", "ümläut 漢字 🙂"),
    ]
    check(spark, rows)


def test_copies_share_every_node(spark):
    rows = [(c * 20, t, "user", f"same {t}") for c in range(2500) for t in range(3)]
    got = check(spark, rows)
    assert len(got) == 4 and got[0][3] == 2500


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_nothing(spark, rows):
    assert trie.prefixes(table(spark, rows)).collect() == []
