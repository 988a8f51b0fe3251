"""Writers: committed batches of derived tables, rebuilds, learnings and artifacts.

A batch writes every table under `batch=<id>` and then one small marker.
Readers see only batches with a marker, so the tables of a batch appear
together, and running a batch again replaces it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.ordered import ordinal
from skein.session import materialise

BUCKETS = 256


def commit_batch(tables: Mapping[str, DataFrame], folder: str, batch_id: int) -> None:
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
    if spark is not None:
        marker = spark.range(1).select(F.lit(batch_id).alias("done"))
        marker.write.mode("overwrite").parquet(f"{folder}/_commits/batch={batch_id}")


def read_committed(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame:
    """Rows of all committed batches, or of those below `before`."""
    # one tiny row per batch; the join prunes uncommitted partitions at run time
    done = spark.read.parquet(f"{folder}/_commits").select("batch").distinct()
    rows = spark.read.parquet(f"{folder}/{name}")
    if before is not None:
        rows, done = rows.filter(F.col("batch") < before), done.filter(F.col("batch") < before)
    return rows.join(done, "batch", "left_semi")


def has_commits(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.parquet(f"{folder}/_commits")
    except AnalysisException:  # no batch has been committed yet
        return False
    return True


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def committed_between(spark: SparkSession, folder: str, name: str, after: int, before: int) -> DataFrame | None:
    """Rows of the committed batches in (after, before), or None; only their folders are looked at."""
    done = [b for b in range(after + 1, before) if path_exists(spark, f"{folder}/_commits/batch={b}/_SUCCESS")]
    paths = [f"{folder}/{name}/batch={b}" for b in done]
    return spark.read.option("basePath", f"{folder}/{name}").parquet(*paths) if paths else None


def last_commit(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/_commits").agg(F.max("batch")).first()[0] if has_commits(spark, folder) else -1


def _overwrite(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_messages(messages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Messages by source and session bucket, the unit of a later rebuild.

    The position is part of the shuffle key, so the rows of one long session
    are written by many tasks.
    """
    spread = messages.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    part = F.floor(F.col("msg_index") / 65536)
    _overwrite(spread.repartition("source", "bucket", part), path, "source", "bucket")


def rebuild_source(messages: DataFrame, path: str, source: str, buckets: int = BUCKETS) -> None:
    """Replace the rows of one source; the other source keeps its files.

    Buckets of the source that the new rows do not reach are emptied too,
    because the rebuild names its partition folder as a whole.
    """
    mine = messages.filter(F.col("source") == source).withColumn(
        "bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")
    )
    part = F.floor(F.col("msg_index") / 65536)
    mine.drop("source").repartition("bucket", part).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("bucket").parquet(f"{path}/source={source}")


def rebuild_sessions(fresh: DataFrame, replaced: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace whole sessions: only their buckets are read and rewritten.

    `fresh` holds the new rows of the sessions in `replaced(session_id)`.
    """
    spark = fresh.sparkSession
    stored = spark.read.parquet(path)
    hit = replaced.select(F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int").alias("bucket")).distinct()
    touched = stored.join(hit, "bucket", "left_semi")
    kept = touched.join(replaced.select("session_id"), "session_id", "left_anti")
    with_bucket = fresh.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    # written elsewhere first: a plan must not overwrite the files it still reads
    staged = materialise(kept.unionByName(with_bucket.select(*kept.columns)), "rebuild")
    part = F.floor(F.col("msg_index") / 65536)
    _overwrite(staged.repartition("source", "bucket", part), path, "source", "bucket")


def write_learnings(learnings: DataFrame, path: str) -> None:
    """One JSON record per learning."""
    learnings.write.mode("append").json(path)


def distinct_names(files: DataFrame, order: str = "body") -> DataFrame:
    """Files of one name told apart: the second in `order` becomes `name~2.md`, which no slug can be.

    `order` is a text column that tells files of one name apart.
    """
    placed = ordinal(files, ["file_name"], [order], F.left(order, F.lit(4)), "_no")
    name, end = (F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", n) for n in (1, 2))
    again = F.concat(name, F.lit("~"), (F.col("_no") + 1).cast("string"), end)
    return placed.withColumn("file_name", F.when(F.col("_no") > 0, again).otherwise(F.col("file_name"))).drop("_no")


def write_artifacts(files: DataFrame, path: str, order: str = "body") -> None:
    """`file_name, body` rows as text, one folder per file name.

    Files written before under the same names are replaced, so a run may be
    repeated; others stay. Rows of one name become files of their own.
    """
    named = distinct_names(files, order).select("file_name", "body")
    named.repartition("file_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "file_name"
    ).text(path)
