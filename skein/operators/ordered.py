"""Ordered operators that never hand one whole key to one task.

A session may hold a large share of all rows, so a plain
`Window.partitionBy(session)` would sort that share in a single task. The
operators here cut every key into buckets along its order column, work inside
(key, bucket), and carry only one small row per bucket across the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from skein.session import materialise

#: rows of one key that a task sees together when positions are dense
CHUNK = 1024


def chunk_of(pos: str | Column, size: int = CHUNK) -> Column:
    """Bucket of a dense integer position."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(size)).cast("long")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, Column],
) -> DataFrame:
    """Inclusive running sum of each expression along `order` within `keys`.

    `bucket` must not decrease along `order`, and keys must not be null. The bucket totals are summed
    map-side first; the prefix over them touches one row per bucket, and the
    join back reuses the (keys, bucket) partitioning of the inner window.
    """
    keys = list(keys)
    inner = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*inner).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in inner],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    here = (
        Window.partitionBy(*inner)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.select("*", *[F.sum(e).over(here).alias(n) for n, e in sums.items()])
    cond = reduce(and_, [F.col(k) == F.col(f"_k_{k}") for k in inner])
    # every bucket has exactly one offset; a left join lets Spark drop it where no sum is used
    joined = local.join(offsets, cond, "left")
    out = [c for c in local.columns if c not in sums and c != "_bucket"]
    return joined.select(*out, *[(F.col(n) + F.coalesce(f"_o_{n}", F.lit(0))).alias(n) for n in sums])


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str
) -> DataFrame:
    """0-based dense position of each row in its key. `order` must be a total order."""
    ranked = running_sums(df, keys, order, bucket, {out: F.lit(1).cast("long")})
    return ranked.withColumn(out, F.col(out) - 1)


def with_halo(
    df: DataFrame, pos: str, before: int = 0, after: int = 0, size: int = CHUNK
) -> DataFrame:
    """Copy rows near a chunk edge into the neighbouring chunk.

    Adds `_chunk` and `_own`. A window over (key, `_chunk`) then sees `before`
    rows behind and `after` rows ahead of every row with `_own` true, and the
    caller keeps only those rows. Positions must be dense.
    """
    if max(before, after) > size:
        raise ValueError("halo wider than a chunk")
    home = chunk_of(pos, size)
    offset = F.col(pos) - home * size
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= size - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        )
    )
    return df.select("*", F.explode(copies).alias("_chunk")).withColumn(
        "_own", F.col("_chunk") == chunk_of(pos, size)
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    exprs: Mapping[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    size: int = CHUNK,
) -> DataFrame:
    """Evaluate window expressions that look at most `before`/`after` rows away.

    Each value of `exprs` takes a window ordered by `pos` and returns a column.
    """
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    wide = with_halo(df, pos, before, after, size)
    wide = wide.select("*", *[make(w).alias(name) for name, make in exprs.items()])
    return wide.filter("_own").drop("_chunk", "_own")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str) -> DataFrame:
    """First `k` rows of each key with their 1-based rank.

    The `rank <= k` filter lets Spark keep only k rows per key and task before
    the shuffle, so a hot key costs k rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def ranges_filled(rows: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """`rows` cut into ranges of `order` at sampled boundaries, each swept once.

    Adds `_range`, and `_last`, the last non-null `value` before the row in its
    range. Rows must differ in `order`; then ranges are of like size whatever the
    spread of the values. A task remembers one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(value))
            if last is None:
                last = pa.nulls(1, column.type)
            known = pa.concat_arrays([last, column])  # row k of the batch is k + 1 here
            at = np.arange(batch.num_rows + 1)
            at[1:][~column.is_valid().to_numpy(zero_copy_only=False)] = 0
            at = np.maximum.accumulate(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, number, np.int32)), known.take(pa.array(at[:-1]))],
                [*batch.schema.names, "_range", "_last"],
            )
            last = known.take(pa.array(at[-1:]))

    kinds = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_last", rows.schema[value].dataType)])
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, kinds)


def last_before(rows: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """The last non-null `value` strictly before each row along `order`, over the whole table.

    Ranges are swept in parallel; one row per range, as many as there are
    shuffle partitions, carries its last value to the ranges after it. The swept
    rows are written, so that a range keeps its number when a task runs again.
    """
    swept = materialise(ranges_filled(rows, order, value), "ordered-swept")
    ends = swept.groupBy("_range").agg(
        F.min(F.struct(*order)).alias("_first"),
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_held"),
    )
    earlier = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_range").alias("_r"), F.last("_held", ignorenulls=True).over(earlier).alias("_carried"))
    joined = swept.join(F.broadcast(carried), F.col("_range") == F.col("_r"))
    return joined.select(*rows.columns, F.coalesce("_last", "_carried").alias(out))
