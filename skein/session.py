"""Session set-up and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, else one inside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


#: while an intermediate result is written or gathered
WRITING = {
    # removes the shuffle files of a query when it has ended, not when the driver happens to collect its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # rows go to Python workers 2 MB at a time, not 10,000 at a time whatever their length; JVM and worker each hold a batch per core
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back.

    For results that several branches of a plan use: the costly part runs once,
    later branches read only the columns they need, and a lost executor re-reads
    files instead of replaying the plan. Its shuffle files go with the write.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """The settings of `WRITING`, which are put back."""
    conf = spark.conf
    before = {key: conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write Parquet with the settings of `WRITING`."""
    with _writing(df.sparkSession):
        df.write.mode(mode).parquet(path)


def gathered(df: DataFrame) -> pa.Table:
    """A result of few rows at the driver, whatever its tasks read, with the settings of `WRITING`."""
    with _writing(df.sparkSession):
        return df.toArrow()


def discard(*tables: DataFrame) -> None:
    """Remove results of `materialise` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
