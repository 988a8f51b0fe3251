"""Connected components of an edge table: stars within each task's bounded share of edges, then alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialise

#: edges of a partition in the rounds
PART_ROWS = 500_000
#: edges that a task reduces together
TOGETHER = 100_000


def forest(edges: DataFrame, together: int = TOGETHER, roots: bool = False) -> DataFrame:
    """(v, m): the same components with fewer edges.

    Each `together` edges (and a batch) of a task are reduced to stars around
    their smallest nodes, which are rows of their own on demand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        seen = 0

        def top(x: int) -> int:
            root = x
            while up.setdefault(root, root) != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        def stars() -> pa.RecordBatch:
            found = [(x, top(x)) for x in list(up)]
            found = [s for s in found if roots or s[0] != s[1]]
            return pa.RecordBatch.from_arrays(
                [pa.array([v for v, _ in found], pa.int64()), pa.array([m for _, m in found], pa.int64())], ["v", "m"]
            )

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
            seen += batch.num_rows
            if seen >= together:
                yield stars()
                up.clear()
                seen = 0
        yield stars()

    return edges.select("a", "b").mapInArrow(run, "v long, m long")


def components(edges: DataFrame, rounds: int = 64, together: int = TOGETHER) -> DataFrame:
    """node, component (its smallest node) for every node of `edges` (a, b: long) that has another.

    Stars of at most `together` edges in all are settled by one bounded task, without shuffles.
    More go through rounds.
    Each round joins a node's larger neighbours, then its smaller ones, to its
    smallest neighbour. A large neighbourhood is only ever aggregated (map-side
    first) and joined row by row, never gathered. Each half round is written to
    the shared folder, so a lost executor re-reads one step. Partitions are
    sized by the number of edges, which no round increases by more than its nodes.
    """
    star = materialise(forest(edges, together), "components-0")
    count = star.count()
    if count < together:
        whole = forest(star.select(F.col("v").alias("a"), F.col("m").alias("b")).coalesce(1), together, roots=True)
        return materialise(whole.select(F.col("v").alias("node"), F.col("m").alias("component")), "components-1")
    parts, seen = max(4, -(-count // PART_ROWS)), None
    for n in range(1, rounds + 1):
        both = star.select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(
            star.select(F.col("m").alias("x"), F.col("v").alias("y"))
        )
        least = both.groupBy("x").agg(F.min("y").alias("y0")).select("x", F.least("x", "y0").alias("least"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("v"), F.col("least").alias("m"))
        large = materialise(large.coalesce(parts), f"components-{n}-large")
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(least, "v").filter("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))
        star = small.unionByName(least.select("v", F.col("least").alias("m"))).distinct()
        star = materialise(star.coalesce(parts), f"components-{n}")
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = star.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return star.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(roots)
