import random

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import nearcopies
from tests.llm import cases


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(texts):
    """{id: smallest id of its group} by comparing all pairs."""
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets, pairs = {i: shingles(t) for i, t in texts.items()}, 0
    for i in texts:
        for j in texts:
            if i < j and min(len(sets[i]), len(sets[j])) * 5 >= max(len(sets[i]), len(sets[j])) * 4:
                if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                    pairs += texts[i] != texts[j]
                    a, b = top(i), top(j)
                    up[max(a, b)] = min(a, b)
    return {i: top(i) for i in texts}, pairs


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [2, 64])
def test_every_pair_of_brute_force_is_linked(spark, small):
    rng = random.Random(5)
    texts, footer = [], " ".join(f"licence{i}" for i in range(30))
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 400))]
        texts.append(" ".join(words) + " " + footer)
        texts += [changed(rng, words, k) + " " + footer for k in (1, 2, 4, len(words) // 40, len(words) // 15)]
    hot = [f"h{rng.randrange(5000)}" for _ in range(200)]
    texts += [changed(rng, hot, rng.randrange(1, 6)) for _ in range(90)]
    texts += ["a b c", "A b  c", "a b c d", "", "a b c d e f"]
    rng.shuffle(texts)
    want, pairs = brute(dict(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(cases.documents(spark, texts), small).collect()}
    assert pairs > 100 and got == want


def test_stage_on_the_table_has_full_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want, pairs = brute(texts)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert pairs > 0 and kept == {i for i, top in want.items() if i == top}


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    left = nearcopies.keep_one(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert None in ids and {0, 3} <= set(ids) and not {1, 2, 4, 5, 9, 12} & set(ids)
    assert nearcopies.keep_one(cases.empty(spark)).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(60)]
    other = " ".join(f"o{rng.randrange(5000)}" for _ in range(60))
    near, nearer = " ".join([*words, "more"]), " ".join([*words, "more", "still"])
    docs = cases.documents(spark, [" ".join(words), near, other, nearer, "x " + other], [3, 5, 5, 6, 5])
    docs = docs.withColumnsRenamed({"row": "_gone_id", "sha": "_TEXT_HASH"})
    left = nearcopies.keep_one(docs)
    assert left.columns == docs.columns
    kept = sorted((r["doc_id"], r["text"]) for r in left.collect())
    assert kept[0] == (3, " ".join(words)) and len(kept) == 2 and kept[1] in {(5, other), (5, "x " + other)}


def test_histograms_bound_what_sets_have_in_common():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 40, 700, 9000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for share in (0, 0.5, 1):
            b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.integers(0, 2**63, n // 2 + 3).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            assert nearcopies.most_common(nearcopies.histogram(a), nearcopies.histogram(b)) >= common
    assert nearcopies.histogram(np.zeros(300, np.uint64)) is None and nearcopies.most_common(None, b"") > 300


def test_boilerplate_shared_by_unlike_texts(spark):
    rng = random.Random(9)
    footer = " ".join(f"f{i}" for i in range(30))
    texts = [footer + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 12))) for _ in range(150)]
    want, _ = brute(dict(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(cases.documents(spark, texts), 8).collect()}
    assert got == want


def test_rounds_that_find_few_links_are_the_last(spark, monkeypatch):
    rng = random.Random(11)
    footer = " ".join(f"f{i}" for i in range(30))
    texts = [footer + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 12))) for _ in range(150)]
    rounds, confirmed = [], nearcopies.confirmed
    monkeypatch.setattr(nearcopies, "confirmed", lambda *a: rounds.append(a[-1]) or confirmed(*a))
    monkeypatch.setattr(nearcopies, "LEAST_NEW", 1.1)
    want, _ = brute(dict(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.groups(cases.documents(spark, texts), 8).collect()}
    assert got == want and rounds in (["round--1", "round-0", "rest"], ["round--1", "round-0", "round-1", "rest"])


def test_covering_masks_bring_sets_together(spark):
    rng = random.Random(3)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(900)] for _ in range(8)]
    texts = [" ".join(w) for w in words] + [" ".join([*w, "end"]) for w in words]
    rows = nearcopies.prints(cases.documents(spark, texts))
    fps = {r["node"]: r["fp"] & (1 << 64) - 1 for r in rows.collect()}
    near = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2}
    assert near and near <= {(r["a"], r["b"]) for r in nearcopies.by_masks(rows).collect()}


def test_fingerprint_of_a_set():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 60_000):
        hashes = rng.integers(0, 2**64, n, dtype=np.uint64)
        want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > n)
        assert nearcopies.fingerprint(hashes) & (1 << 64) - 1 == want
    assert nearcopies.fingerprint(np.zeros(0, np.uint64)) == 0
