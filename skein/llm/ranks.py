"""Dense positions of rows inside keys of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import bounded
from skein.session import materialise


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """`df` with `rank` (0-based place of the row in its key along `order`, null first) and `size` (rows of the key).

    Rows are range-partitioned by key and order, so a hot key lies in many
    partitions; its offsets need one row per partition. The rows are written
    under `name` before they are sampled for the ranges, so that what made them
    runs once, and again when sorted. Null keys are a key of their own. Rows equal in
    `order` get their places in any order, so `order` should decide between
    rows that differ elsewhere.
    """
    keys, along = list(keys), [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    rows = materialise(df, f"{name}-rows").repartitionByRange(*along).sortWithinPartitions(*along)
    rows = rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    rows = materialise(rows, name)
    spans = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = materialise(
        spans.select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("_part").alias("_key_part"),
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_rows").over(whole).alias("size"),
        ),
        f"{name}-spans",
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_part") == F.col("_key_part"))
    joined = rows.join(bounded(spans, spans.count(), 128), same)
    return joined.select(*df.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "size")
