import zlib

import numpy as np
import pytest

from skein.llm import quality
from tests.llm import cases

FOLDER = "/root/testdata/sf0.01"


def test_statistics_of_awkward_texts():
    for t in [*cases.TEXTS, "\x00\x01", "\n\n\n", "a" * 3_000_000, "🙂" * 10, "!!!!"]:
        x = quality.statistics(t or "")
        assert len(x) == quality.WIDTH and np.isfinite(x).all()


def test_statistics_count_shares():
    x = quality.statistics("Ab 1#")
    assert x[0] == pytest.approx(np.log(6)) and x[2] == pytest.approx(2 / 5)
    assert x[3] == pytest.approx(1 / 2) and x[5] == pytest.approx(1 / 5)
    assert x[20 + quality._MARKS.index("#")] == pytest.approx(1 / 5)


def test_risk_is_learned_without_negatives():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (20_000, quality.WIDTH)), rng.normal(0, 1, (6000, quality.WIDTH))
    bad[:, 3] += 4
    model = quality.learn(good[:8000], np.concatenate([good[8000:16_000], bad[:2000]]), 0.8)
    assert (model.score(good[16_000:]) >= 0.5).mean() > 0.95 and (model.score(bad[2000:]) < 0.5).mean() > 0.75


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, some).count() == docs.count()
    assert quality.classify(cases.empty(spark), some).count() == 0


def test_positive_labels_alone_suffice(spark):
    """No negative label: the prior still comes out, and junk is told apart."""
    rng = np.random.default_rng(3)
    words = ["river", "stone", "meadow", "under", "quiet", "walks", "morning", "letter"]
    rows, kinds = [], {}
    for n in range(3000):
        kinds[n] = good = rng.random() < 0.6
        if good:
            text = " ".join(" ".join(rng.choice(words, 9)).capitalize() + "." for _ in range(rng.integers(2, 9)))
        else:
            text = " ".join(rng.choice(["$$$", "buy!!", "9981", "##", "CLICK"], int(rng.integers(10, 80))))
        rows.append((n, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(n, 1) for n, good in kinds.items() if good and n % 5 == 0], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert np.mean([r["predicted"] == kinds[r["doc_id"]] for r in got]) >= 0.98
    _, prior = quality.fit_measured(quality.measured(docs, "doc_id"), labels)
    assert abs(prior - 0.6) <= 0.08


def test_prior_bound_against_every_threshold():
    rng = np.random.default_rng(5)
    p, u = rng.integers(0, 50, 40), rng.integers(1, 200, 40)
    doubt = (np.log(40) / (2 * u.sum())) ** 0.5 + (np.log(40) / (2 * p.sum())) ** 0.5
    best = None
    for k in range(40):
        ps, us = p[k:].sum() / p.sum(), u[k:].sum() / u.sum()
        if ps and (best is None or (us + doubt) / ps <= best[0]):
            best = ((us + doubt) / ps, us / ps)
    assert quality.prior_bound(p, u) == pytest.approx(min(0.99, max(0.01, best[1])))
    assert quality.prior_bound(np.zeros(4, int), np.ones(4, int)) == 0.5


def test_scores_match_a_plain_version(spark):
    """Every score again, text by text, from the model's formula."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), [np.full(quality.WIDTH, k) for k in (0.0, 0.5, 1.0, 2.0)],
                          np.linspace(-1, 1, quality.WIDTH * 5), 0.25)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    for r in docs.collect():
        z = [min(4.0, max(-4.0, v)) for v in quality.statistics(r["text"] or "")]
        hinges = z + [max(0.0, v - k) for k in (0.0, 0.5, 1.0, 2.0) for v in z]
        g = sum(a * b for a, b in zip(hinges, model.weights)) + 0.25
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + np.exp(-max(-30, min(30, g)))))
