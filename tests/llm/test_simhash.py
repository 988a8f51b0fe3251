import random

import numpy as np
import pytest
import xxhash

from skein.llm import components as stars
from skein.llm import simhash
from skein.llm.components import components
from skein.session import materialise
from tests.llm import cases


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text:
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """prints: [(doc_id, fp)] -> {doc_id: component}; ids may be None."""
    group = list(range(len(prints)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                group[top(i)] = top(j)
    out = {}
    for i, (doc, _) in enumerate(prints):
        members = [d for j, (d, _) in enumerate(prints) if top(j) == top(i) and d is not None]
        out[i] = min(members) if members else None
    return out


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)
    assert min(m.bit_count() for m in masks) >= 32


def test_fingerprints_and_components(spark):
    docs = cases.awkward(spark)
    rows = docs.collect()
    got = simhash.near_groups(docs).collect()
    want = brute_groups([(r["doc_id"], brute_print(r["text"])) for r in rows])
    expected = sorted(((r["doc_id"], f"{brute_print(r['text']):016x}", want[i]) for i, r in enumerate(rows)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == expected


def linked(spark, prints, small):
    fps = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    edges = simhash.links(fps, small=small)
    for r in edges.collect():
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2
    roots = {r["node"]: r["component"] for r in components(edges).collect()}
    return [roots.get(simhash.signed(p), simhash.signed(p)) for p in prints]


def test_no_pair_is_missed_in_small_and_crowded_buckets(spark):
    rng = random.Random(5)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(15):
            base ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(base)
    for _ in range(60):  # neighbours of one value: crowded buckets in several tables
        prints.add((1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = sorted(prints)
    want = brute_groups([(i, p) for i, p in enumerate(prints)])
    for small in (64, 2):
        got = linked(spark, prints, small)
        pairs = {}
        for i, root in enumerate(got):
            assert pairs.setdefault(root, want[i]) == want[i]
        assert len(pairs) == len(set(want.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500


@pytest.mark.parametrize("together", [3, 100_000])
def test_few_edges_are_settled_without_rounds(spark, monkeypatch, together):
    written = []
    monkeypatch.setattr(stars, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(70, 70), (-5, 90), (90, -5)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    near = {x: {x} for p in pairs for x in p}
    for a, b in pairs:
        both = near[a] | near[b]
        for x in both:
            near[x] = both
    got = {r["node"]: r["component"] for r in components(edges, together=together).collect()}
    assert got == {x: min(all_of) for x, all_of in near.items() if len(all_of) > 1}
    assert (written == ["components-0", "components-1"]) == (together > 3)


def test_empty(spark):
    assert simhash.near_groups(cases.empty(spark)).count() == 0


def test_long_text_is_hashed_in_parts():
    words = [str(i) for i in range(120_000)]
    whole = simhash.fingerprint_of(" ".join(words).encode())
    hashes = np.array([xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(len(words) - 2)], dtype=np.uint64)
    bits = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
    assert whole == bits
