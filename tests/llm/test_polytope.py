import numpy as np
import pytest

from skein.llm import polytope

SCHEMA = "vec_id long, embedding array<float>, label int, cid long, code string, n int, vec string, m int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "?", 2, "?", 3) for r in rows], SCHEMA)


def brute(rows, threshold=0.93):
    """{row number: (n_links, component)}, cosines of at least `threshold` among equal labels."""
    vectors = []
    for _, vec, label in rows:
        fine = label is not None and vec and all(x is not None and np.isfinite(np.float32(x)) for x in vec)
        v = np.array(vec, np.float32).astype(np.float64) if fine else None
        vectors.append(v / np.linalg.norm(v) if fine and np.any(v) else None)
    n = len(rows)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= threshold:
                links[i].append(j)
                links[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), component, rows[i][0] == component))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    return sorted(map(tuple, polytope.near_vectors(table(spark, rows), **options).collect()), key=repr)


def near(rng, base, cosine):
    """A vector at exactly this cosine from `base`."""
    base = base / np.linalg.norm(base)
    other = rng.normal(size=len(base))
    other -= (other @ base) * base
    return cosine * base + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def as_rows(vectors, labels):
    return [(i, [float(np.float32(x)) for x in v], int(g)) for i, (v, g) in enumerate(zip(vectors, labels, strict=True))]


def test_hadamard_is_orthonormal():
    turned = polytope.rotated(np.eye(48), 1, 2)
    assert turned.shape == (48, 64) and np.allclose(turned @ turned.T, np.eye(48))


def test_borderline_pairs_and_chains(spark):
    rng = np.random.default_rng(3)
    vectors, labels = [], []
    for n in range(260):
        base = rng.normal(size=64)
        vectors.append(base)
        for cosine in (0.9301, 0.931, 0.94, 0.929, 0.97)[: n % 6]:
            vectors.append(near(rng, vectors[-1], cosine) * rng.uniform(0.01, 50))
        labels += [n % 3] * (len(vectors) - len(labels))
    rows = as_rows(vectors, labels)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("bucket", [8, 256])
def test_crowded_cluster(spark, monkeypatch, bucket):
    monkeypatch.setattr(polytope, "BUCKET", bucket)
    rng = np.random.default_rng(4)
    base = rng.normal(size=32)
    vectors = [near(rng, base, c) for c in rng.uniform(0.95, 0.999, size=150)] + list(rng.normal(size=(100, 32)))
    rows = as_rows(vectors, [1] * 250)
    rows += [(1000 + i, rows[0][1], 1) for i in range(30)]
    assert found(spark, rows) == brute(rows)


def test_several_rotations_a_name(spark, monkeypatch):
    monkeypatch.setattr(polytope, "CELL", 1)
    rng = np.random.default_rng(5)
    vectors = list(rng.normal(size=(150, 20)))
    vectors += [near(rng, v, c) for v, c in zip(vectors, rng.uniform(0.925, 0.99, size=150))]
    rows = as_rows(vectors, [7] * 300)
    assert polytope.scheme(20, 300)[0] == 2
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0, 3.0], 1), (1, [2.0, 4.0, 6.0], 1), (2, [1.0, 2.0, 3.0], None), (3, [1.0, 2.0, 3.0], 2), (4, None, 1), (5, [], 1),
        (6, [0.0, 0.0, 0.0], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, nan, 3.0], 1), (10, [1.0, inf, 3.0], 1),
        (11, [1.0, nan, 3.0], 1), (None, [1.0, 2.0, 3.0], 1), (None, [-5.0, 1.0, 0.0], 1), (12, [1.0, 2.0], 1), (13, [1.0, 2.0], 1),
        (14, [3.0], 1), (15, [9.0], 1), (16, [-3.0], 1), (17, [-1.0, -2.0, -3.0], 1), (0, [1.0, 2.0, 3.0], 1), (18, [3e38, 3e38, 0.0], 4),
        (19, [1e-38, 1e-38, 0.0], 4),
    ]
    assert found(spark, rows) == brute(rows)


def test_empty_and_unusable(spark):
    assert found(spark, []) == []
    assert found(spark, [(3, None, 1)]) == [(3, 0, 3, True)]
