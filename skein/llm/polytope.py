"""Near-duplicate vectors by cross-polytope hashing.

A table turns a vector with `parts` pseudo-random rotations (three rounds of
random signs and a fast Hadamard transform, on the length padded to a power of
two) and names it by the largest coordinate, with its sign, of each. The
`PROBES` most likely names of both sides are filed, so neighbours meet although
a border lies between them. The number of tables follows from a simulation at
the threshold: pairs of cosine `threshold` are missed with a probability of at
most `MISS`, closer ones more rarely.

In a bucket, vectors are first held against each other by 128 sign bits; only
those with a plausible partner are sent there in full, where the cosine is
computed in double precision. Large buckets are cut into chunks and every two
chunks meet in a task of their own, so no bucket is capped. A link is counted
in the first bucket that both vectors share, and leaves a task as a count per
vector and a spanning forest, never as a list of pairs. Equal vectors are one
vector with a weight.

Defined cases: a null label, a vector that is null, empty or zero or that holds
null or non-finite components, and vectors of unlike lengths link with nothing;
a null vec_id takes part but names no component unless no row of it has an id;
a repeated vec_id is a row of its own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded
from skein.llm.components import components
from skein.session import materialise

#: cosine of a link
THRESHOLD = 0.93
#: names under which a vector is filed in a table
PROBES = 4
#: probability that no table joins a pair at the threshold
MISS = 1e-5
#: vectors of a label and cell that the number of rotations aims at, at most
CELL = 64
#: vectors of a bucket that meet in one task; larger buckets are cut into chunks of half as many
BUCKET = 256
#: tables, at most: a code is name * TABLES + table
TABLES = 1024
#: words of 64 sign bits
SIGNS = 2

_KEY = ["label", "dim", "code"]


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the length is a power of two."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, -1, 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / math.sqrt(width)


def rotated(unit: np.ndarray, *seed: int) -> np.ndarray:
    """Rows padded to a power of two and turned by the rotation of `seed`."""
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    out = np.zeros((n, width))
    out[:, :dim] = unit
    for signs in np.random.default_rng([13, dim, *seed]).choice([-1.0, 1.0], size=(3, width)):
        out = hadamard(out * signs)
    return out


def names(unit: np.ndarray, table: int, parts: int, probes: int = PROBES) -> np.ndarray:
    """The most likely names of each row in a table, best first."""
    codes, costs = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for part in range(parts):
        turned = rotated(unit, table, part)
        width = turned.shape[1]
        size = np.abs(turned)
        most = min(width, probes + 1)
        top = np.argpartition(-size, most - 1, axis=1)[:, :most]
        value = np.take_along_axis(turned, top, 1)
        gap = (size.max(axis=1, keepdims=True) - np.abs(value)) ** 2
        codes = (codes[:, :, None] * (2 * width) + (2 * top + (value < 0))[:, None, :]).reshape(len(unit), -1)
        costs = (costs[:, :, None] + gap[:, None, :]).reshape(len(unit), -1)
        best = np.argsort(costs, axis=1, kind="stable")[:, : max(probes, 1)]
        codes, costs = np.take_along_axis(codes, best, 1), np.take_along_axis(costs, best, 1)
    return codes


def sign_bits(unit: np.ndarray) -> np.ndarray:
    """SIGNS words of sign bits of random rotations of each row."""
    got = []
    for n in range(64 * SIGNS):
        if len(got) * 64 >= 64 * SIGNS:
            break
        turned = rotated(unit, TABLES + n, 0) > 0
        need = max(1, 64 // turned.shape[1])
        if need > 1:
            turned = np.concatenate([turned, *[rotated(unit, TABLES + n, 1 + k) > 0 for k in range(need - 1)]], axis=1)
        for at in range(0, turned.shape[1] - 63, 64):
            got.append(np.packbits(turned[:, at : at + 64], axis=1).view(np.uint64)[:, 0])
    return np.stack(got[:SIGNS], axis=1)


def differing(threshold: float) -> int:
    """Sign bits in which a linked pair differs at most: six standard deviations over the mean at the threshold."""
    p, n = math.acos(threshold) / math.pi, 64 * SIGNS
    return math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p)))


def scheme(dim: int, rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Rotations of a name and number of tables for labels of up to `rows` vectors."""
    width = 2 << max(1, (dim - 1).bit_length())
    parts = max(1, math.ceil(math.log(max(1, rows / CELL)) / math.log(width)))
    if dim == 1:
        return 1, 1
    rng = np.random.default_rng([dim, parts])
    a, b = rng.normal(size=(2, 4096, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + math.sqrt(1 - threshold**2) * b
    met = [(names(a, t, parts)[:, :, None] == names(b, t, parts)[:, None, :]).any(axis=(1, 2)).mean() for t in range(4)]
    hit = min(float(np.mean(met)), 0.99)
    return parts, min(TABLES, max(1, math.ceil(math.log(miss) / math.log(1 - hit))))


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    rows = flat.reshape(-1, dim).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def signatures(classes: DataFrame, schemes: dict[int, tuple[int, int]]) -> DataFrame:
    """`classes` with codes (name and table of every bucket) and sign bits."""
    schema = classes.drop("first").schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                mine = whole.filter(pa.array(dims == dim))
                parts, tables = schemes[dim]
                for start in range(0, mine.num_rows, 2048):
                    batch = mine.slice(start, 2048)
                    unit = _unit(batch.column("vec").flatten().to_numpy(), dim)
                    codes = np.concatenate([names(unit, t, parts) * TABLES + t for t in range(tables)], axis=1)
                    offsets = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
                    bits = sign_bits(unit).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.ListArray.from_arrays(offsets, codes.ravel()), *(pa.array(w) for w in bits.T)],
                        [*batch.schema.names, "codes", *(f"bits{i}" for i in range(SIGNS))],
                    )

    bits = ", ".join(f"bits{i}: bigint" for i in range(SIGNS))
    return classes.drop("first").mapInArrow(run, f"{schema}, codes: array<bigint>, {bits}".replace(":", " "))


def _grouped(work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], keys: list[str]):
    """An Arrow function that gives `work` whole runs of equal `keys` of sorted rows, with the run number of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def starts(rows: pa.Table) -> np.ndarray:
            new = np.zeros(rows.num_rows, bool)
            new[:1] = True
            for k in keys:
                column = rows.column(k).to_numpy()
                new[1:] |= column[1:] != column[:-1]
            return new

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            cut = int(np.flatnonzero(starts(rows))[-1]) if rows.num_rows else 0
            rest = rows.slice(cut).combine_chunks()
            if cut:
                whole = rows.slice(0, cut).combine_chunks()
                yield work(whole, np.cumsum(starts(whole)))
        if rest is not None and rest.num_rows:
            yield work(rest, np.cumsum(starts(rest)))

    return run


def _runs(group: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def plausible(entries: DataFrame, threshold: float) -> DataFrame:
    """Entries of small buckets whose sign bits lie near those of another entry of the bucket."""
    most = differing(threshold)

    def work(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        bits = np.stack([rows.column(f"bits{i}").to_numpy() for i in range(SIGNS)], axis=1).view(np.uint64)
        keep = np.zeros(len(group), bool)
        for a in range(1, len(group)):
            same = np.flatnonzero(group[a:] == group[:-a])
            if not len(same):
                break
            near = np.bitwise_count(bits[same] ^ bits[same + a]).sum(axis=1) <= most
            keep[same[near]] = keep[same[near] + a] = True
        kept = rows.select([*_KEY, "cid", "m"]).filter(pa.array(keep)).combine_chunks()
        return kept.to_batches()[0] if kept.num_rows else pa.RecordBatch.from_pylist([], kept.schema)

    sorted_rows = entries.repartition(*_KEY).sortWithinPartitions(*_KEY)
    return sorted_rows.mapInArrow(_grouped(work, _KEY), "label long, dim int, code long, cid long, m long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the links (a, b) join it to."""
    top = np.arange(n)
    while len(a):
        least = np.minimum(top[a], top[b])
        before = top.copy()
        np.minimum.at(top, a, least)
        np.minimum.at(top, b, least)
        top = top[top]
        if (top == before).all():
            break
    return top


def linked(met: DataFrame, threshold: float) -> DataFrame:
    """cid, links (weight of the vectors found linked here first) and root (a linked cid) of vectors that meet in a bucket.

    met: label, dim, code, ci, cj (chunks that meet), side, cid, n, codes, vec
    """

    def work(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        dims, side = rows.column("dim").to_numpy(), rows.column("side").to_numpy()
        within = rows.column("ci").to_numpy() == rows.column("cj").to_numpy()
        at = rows.column("code").to_numpy()
        pairs_a, pairs_b = [], []
        for dim in np.unique(dims).tolist():
            mine = np.flatnonzero(dims == dim)
            unit = _unit(rows.column("vec").take(pa.array(mine)).combine_chunks().flatten().to_numpy(), dim)
            number = group[mine]
            edges = _runs(number)
            small = np.repeat([hi - lo <= 16 for lo, hi in edges], [hi - lo for lo, hi in edges])
            for step in range(1, 16):
                same = np.flatnonzero((number[step:] == number[:-step]) & small[step:])
                if not len(same):
                    break
                near = (unit[same] * unit[same + step]).sum(axis=1) >= threshold
                pairs_a.append(mine[same[near]])
                pairs_b.append(mine[same[near] + step])
            for lo, hi in edges:
                if hi - lo > 16:
                    i, j = np.nonzero(np.triu(unit[lo:hi] @ unit[lo:hi].T >= threshold, 1))
                    pairs_a.append(mine[lo + i])
                    pairs_b.append(mine[lo + j])
        a = np.concatenate([np.empty(0, np.int64), *pairs_a]).astype(np.int64)
        b = np.concatenate([np.empty(0, np.int64), *pairs_b]).astype(np.int64)
        good = within[a] | (side[a] != side[b])
        a, b = a[good], b[good]
        # a pair is counted in the first of its common buckets only
        codes = rows.column("codes").combine_chunks()
        flat, offsets = codes.flatten().to_numpy(), codes.offsets.to_numpy() - codes.offsets[0].as_py()
        table, first = at % TABLES, np.ones(len(a), bool)
        for t in range(int(table[a].max(initial=-1)) + 1):
            live = np.flatnonzero(first & (table[a] >= t))
            if not len(live):
                continue
            i, j = a[live], b[live]
            least = np.full(len(live), np.iinfo(np.int64).max)
            for p in range(PROBES):
                ours = flat[offsets[i] + t * PROBES + p]
                for q in range(PROBES):
                    least = np.where(ours == flat[offsets[j] + t * PROBES + q], np.minimum(least, ours), least)
            first[live] = np.where(table[i] == t, least == at[i], least == np.iinfo(np.int64).max)
        a, b = a[first], b[first]
        weight, links = rows.column("n").to_numpy(), np.zeros(len(group), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        top, cid, some = _forest(len(group), a, b), rows.column("cid").to_numpy(), np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(cid[top[some]])], ["cid", "links", "root"])

    keys = [*_KEY, "ci", "cj"]
    dealt = met.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_grouped(work, keys), "cid long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors` (vec_id, embedding, label)."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("vec"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.filter("usable").groupBy("label", "vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "label", F.size("vec").alias("dim"), "n", "vec", "first")
    classes = materialise(classes, "polytope-classes")

    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows")).groupBy("dim").agg(F.max("rows").alias("rows"))
    schemes = {r["dim"]: scheme(r["dim"], r["rows"], threshold, miss) for r in sizes.collect()}
    signed = materialise(signatures(classes, schemes), "polytope-signed")

    bits = [f"bits{i}" for i in range(SIGNS)]
    entries = signed.select("label", "dim", F.explode("codes").alias("code"), "cid", *bits)
    crowd = entries.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = materialise(entries.join(crowd, _KEY), "polytope-shared")
    near = plausible(shared.filter(F.col("m") <= BUCKET), threshold)
    wanted = near.unionByName(shared.filter(F.col("m") > BUCKET).select(near.columns))
    chunks = F.when(F.col("m") > BUCKET, F.ceil(F.col("m") * 2 / BUCKET)).otherwise(1).cast("int")
    wanted = wanted.select("*", chunks.alias("chunks"), F.pmod(F.xxhash64("cid"), chunks).cast("int").alias("chunk"))
    wanted = wanted.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    wanted = wanted.select(
        *_KEY, "cid", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"),
        (F.col("chunk") > F.col("other")).cast("int").alias("side"),
    )
    met = wanted.join(signed.select("cid", "n", "codes", "vec"), "cid")
    found = materialise(linked(met, threshold), "polytope-links")

    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    of = classes.select("cid", "label", "vec", "n", "first").join(counts, "cid", "left")
    of = of.join(joined.select(F.col("node").alias("cid"), "component"), "cid", "left")
    of = materialise(of.select("label", "vec", "first", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "polytope-of")
    named = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.filter("n_links > 0").join(named, "component").select("label", "vec", "n_links", "component_id")
    of = materialise(of, "polytope-named")
    of = bounded(of, of.count(), 4096)
    got = rows.filter("usable").join(of, ["label", "vec"], "left").select("vec_id", "n_links", "component_id")
    none = [F.lit(None).cast("long").alias("n_links"), F.lit(None).cast(rows.schema["vec_id"].dataType).alias("component_id")]
    got = got.unionByName(rows.filter("NOT usable").select("vec_id", *none))
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return got.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
