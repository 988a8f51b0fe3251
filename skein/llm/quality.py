"""Quality classifier by positive-unlabelled learning.

The model minimises the non-negative unbiased risk: with trusted positives P,
unlabelled text U, class prior p and logistic loss l,

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])

so no text is taken as a negative example. U is ordinary web text, labelled or
not; P are the rows labelled 1 that may be learned from. Rows labelled 0 are
like unlabelled ones, here and in the prior.

The prior comes from P and U alone. A model that tells P from U is fitted on
one half of the ids; on the other half, the share of U among its best-scored
texts over the share of P there bounds the prior from above, and nearly reaches
it where texts are surely good. The smallest such bound counts, with an
allowance for the number of rows behind it.

g is linear in hinges of text statistics. Training takes about `FIT_DOCS` rows
of P and of U, chosen by a hash of the id (whole texts); the prior and the scores
cover all rows, whose statistics are computed once and stored.

Defined cases: a null text is the empty text and is scored like any other;
labels without quality or id are ignored; without any positive label that has a
text every score is 0.5; with so few rows that one half holds no positive the prior
is 0.5; repeated rows each get a row; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import for_learning, held_out, pieces, sampled
from skein.session import materialise

#: expected rows of the positive and of the unlabelled training sample
FIT_DOCS = 8000
#: score from which a text is predicted good
THRESHOLD = 0.7
#: knots of the hinges per statistic
KNOTS = 4
#: score bins that the prior is read from, and the chance that its allowance is too small
BINS, DOUBT = 1000, 0.1
STEPS, RATE, DECAY = 600, 0.05, 1e-3

_MARKS = "#$%&*!?|.,;:\"'()-_=/<>@+"


@cache
def _classes() -> np.ndarray:
    """0 other, 1 lower, 2 upper, 3 other letter, 4 digit, 5 blank, 6 line end, 7 control, 8 + n the n-th mark."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        s = chr(c)
        out[c] = 1 if s.islower() else 2 if s.isupper() else 3 if s.isalpha() else 4 if s.isdecimal() else 0
        if out[c] == 0 and s.isspace():
            out[c] = 5
        elif out[c] == 0 and c < 32:
            out[c] = 7
    out[10] = 6
    for n, mark in enumerate(_MARKS):
        out[ord(mark)] = 8 + n
    return out


def statistics(text: str) -> list[float]:
    """Shape of a text; all values are shares, logarithms or small means."""
    counts = np.zeros(8 + len(_MARKS), dtype=np.int64)
    doubled = 0
    for start in range(0, len(text), 1 << 20):
        codes = np.frombuffer(text[start : start + (1 << 20)].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = _classes()[codes]
        counts += np.bincount(kinds, minlength=len(counts))
        marks = kinds >= 8
        doubled += int(np.count_nonzero(marks[1:] & (codes[1:] == codes[:-1])))
    n = max(1, len(text))
    letters = max(1, int(counts[1:4].sum()))
    words = text.split()
    many = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    lower = [w.lower() for w in words]
    frequent = len(set(lower)) / many
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        letters / n,
        counts[2] / letters,
        counts[3] / letters,
        counts[4] / n,
        counts[5] / n,
        np.log1p(counts[6]),
        counts[0] / n,
        counts[7] / n,
        counts[8:].sum() / n,
        doubled / n,
        sum(map(len, words)) / many,
        frequent,
        sum(len(w) <= 3 for w in words) / many,
        sum(not w[-1].isalnum() for w in words) / many,
        np.log1p(many / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        max(map(len, words), default=0) ** 0.5,
        sum(a == b for a, b in zip(lower, lower[1:])) / many,
        *(counts[8:] / n),
    ]


WIDTH = 20 + len(_MARKS)


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """`more` columns and the statistics (x) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = pa.array([statistics(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], [*more, "x"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.select(*more, "text").mapInArrow(run, f"{kinds + ', ' if more else ''}x array<double>")


class Model:
    """Hinges of standardised statistics, their weights, and an offset."""

    def __init__(self, middle, scale, knots, weights, offset):
        self.middle, self.scale, self.knots, self.weights, self.offset = middle, scale, knots, weights, offset

    @staticmethod
    def expand(x: np.ndarray, middle, scale, knots) -> np.ndarray:
        z = np.clip((x - middle) / scale, -4, 4)
        return np.concatenate([z, *(np.maximum(0, z - k) for k in knots)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        g = self.expand(x, self.middle, self.scale, self.knots) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Model:
    """Full-batch Adam on the non-negative unbiased risk; without a prior, on telling P from U."""
    both = np.concatenate([positive, unlabelled])
    middle = np.median(both, axis=0)
    scale = np.maximum(both.std(axis=0), 1e-6)
    z = np.clip((both - middle) / scale, -4, 4)
    knots = [np.quantile(z, q, axis=0) for q in np.linspace(0.1, 0.95, KNOTS)]
    p = Model.expand(positive, middle, scale, knots)
    u = Model.expand(unlabelled, middle, scale, knots)
    w = np.zeros(p.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior)) if prior else 0
    first, second = np.zeros_like(w), np.zeros_like(w)
    p, u = np.column_stack([p, np.ones(len(p))]), np.column_stack([u, np.ones(len(u))])
    logistic = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for step in range(1, STEPS + 1):
        sp, su = logistic(p @ w), logistic(u @ w)
        if prior is None:
            gradient = p.T @ ((sp - 1) / len(p)) + u.T @ (su / len(u))
        else:
            negative_risk = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
            good = p.T @ ((sp - 1) * prior / len(p))
            bad = u.T @ (su / len(u)) - p.T @ (sp * prior / len(p))
            # where the estimated risk of the negatives is below zero, step back from it instead
            gradient = good + bad if negative_risk >= 0 else -bad
        gradient[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = RATE * (1 - step / (STEPS + 1))
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(middle, scale, knots, w[:-1], w[-1])


def prior_bound(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from counts of P and of U by score bin, the best bin last."""
    p, u = np.cumsum(positive[::-1]), np.cumsum(unlabelled[::-1])
    if not p[-1] or not u[-1]:
        return 0.5
    p_share, u_share = p / p[-1], u / u[-1]
    doubt = (np.log(4 / DOUBT) / (2 * u[-1])) ** 0.5 + (np.log(4 / DOUBT) / (2 * p[-1])) ** 0.5
    seen = p > 0
    at = np.argmin((u_share[seen] + doubt) / p_share[seen])
    return float(np.clip(u_share[seen][at] / p_share[seen][at], 0.01, 0.99))


def _half() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))


def _binned(x: DataFrame, model: Model) -> DataFrame:
    """part and score bin of rows (part, x)."""
    shared = x.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            s = shared.value.score(np.array(batch.column(1).to_pylist()))
            at = np.minimum((s * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], ["part", "bin"])

    return x.select("part", "x").mapInArrow(run, "part int, bin int")


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, part and half of sampled rows, in an order that does not depend on the tasks'."""
    x = np.array(rows["x"].to_pylist(), dtype=np.float64).reshape(rows.num_rows, WIDTH)
    order = np.lexsort(x.T[::-1])
    return x[order], rows["part"].to_numpy()[order], rows["half"].to_numpy()[order]


def fit_measured(x: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[Model, float]:
    """Model and class prior from the rows (doc_id, x) that may be learned from."""
    flat = Model(np.zeros(WIDTH), np.ones(WIDTH), [np.zeros(WIDTH)] * KNOTS, np.zeros(WIDTH * (KNOTS + 1)), 0.0)
    good = labels.filter(for_learning() & (F.col("quality") == 1)).select("doc_id").distinct()
    unlabelled = x.filter(for_learning()).select("doc_id", "x", F.lit(0).alias("part"))
    # the positives with a text, as their statistics: one semi join, whatever their number
    positive = materialise(unlabelled.join(good, "doc_id", "left_semi").withColumn("part", F.lit(1)), "quality-positive")
    n_positive, total = positive.count(), unlabelled.count()
    if not n_positive:
        return flat, 0.5
    chosen = positive.filter(sampled(min(1.0, fit_docs / n_positive), "doc_id"))
    # another hash than for the positives, else U would hold more of them than the text does
    other = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1_000_000)) < min(1.0, fit_docs / total) * 1_000_000
    rows = chosen.unionByName(unlabelled.filter(other)).select("part", _half().alias("half"), "x")
    values, part, half = _arrays(rows.toArrow())

    def of(kind: int, *halves: int) -> np.ndarray:
        return values[(part == kind) & np.isin(half, halves)]

    prior = 0.5
    if len(of(1, 0)) and len(of(0, 0)):
        apart = learn(of(1, 0), of(0, 0), None)
        second = positive.unionByName(unlabelled).filter(_half() == 1)
        counts = np.zeros((2, BINS), dtype=np.int64)
        for r in _binned(second, apart).groupBy("part", "bin").count().collect():  # 2 * BINS rows at most
            counts[r["part"], r["bin"]] = r["count"]
        prior = prior_bound(counts[1], counts[0])
    if not len(of(1, 0, 1)) or not len(of(0, 0, 1)):
        return flat, prior
    return learn(of(1, 0, 1), of(0, 0, 1), prior), prior


def score_measured(x: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (doc_id, x)."""
    shared = x.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            s = shared.value.score(np.array(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = x.schema["doc_id"].dataType.simpleString()
    return x.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Model from the rows that may be learned from."""
    return fit_measured(materialise(measured(docs.filter(for_learning()), "doc_id"), "quality-measured"), labels, fit_docs)[0]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its text alone."""
    return score_measured(measured(docs, "doc_id"), model, threshold)


def classify(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    x = materialise(measured(docs, "doc_id"), "quality-measured")
    return score_measured(x, fit_measured(x, labels, fit_docs)[0])
