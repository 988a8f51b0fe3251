"""Several tables that change together, and rows that go for good.

A store is a folder of tables. Data files are never changed; a generation is
the list of files that every table has, and one small pointer file per generation,
put in place by a rename that fails when the name is taken, makes it visible.
A change of many tables is thus seen whole or not at all, a reader keeps the
generation it began with, and of two writers that start from one generation the second gets
`Conflict` and has changed nothing.

    _generations/<n>           pointer: the list's folder, the tables' schemas
    _lists/<id>                (table, file, rows), one row per data file
    <table>/<id>/part-*        data files

Forgetting sessions takes two steps. `forget` writes marks: readers leave the
rows out from then on. `compact` writes anew the files that hold marked rows, and no others;
`expire` then removes the files that no kept generation lists.

Defined cases: a table without rows keeps its schema; a table without the key column
is not touched by forgetting; marks of unknown or null sessions hit nothing; later rows
of a marked session are hidden, and removed, up to the next `compact`, which clears
the marks. The driver holds the file names it reads or expires, never rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import materialise

#: table of marks
GONE = "_gone"
LIST = "table string, file string, rows bigint"


class Conflict(RuntimeError):
    """Another writer has committed the generation that this one was to become."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _statuses(spark: SparkSession, path: str) -> list:
    fs, at = _fs(spark, path)
    return list(fs.listStatus(at)) if fs.exists(at) else []


class Store:
    """Tables of `folder` as of its newest generation, or of the one given."""

    def __init__(self, spark: SparkSession, folder: str, generation: int | None = None):
        self.spark, self.folder, self.pinned = spark, folder.rstrip("/"), generation

    # --- what is visible ----------------------------------------------------

    def generations(self) -> list[int]:
        names = (s.getPath().getName() for s in _statuses(self.spark, f"{self.folder}/_generations"))
        return sorted(int(n) for n in names if n.isdigit())

    def pin(self) -> Store:
        """The same store held at the generation that is newest now."""
        return Store(self.spark, self.folder, self.generation())

    def generation(self) -> int:
        """Number of the generation read, 0 for a store without one."""
        return self.pinned if self.pinned is not None else max(self.generations(), default=0)

    def _pointer(self, generation: int) -> dict:
        if not generation:
            return {"list": None, "schemas": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/_generations/{generation}", wholetext=True).first()[0])

    def _files(self, pointer: dict) -> DataFrame:
        if pointer["list"] is None:
            return self.spark.createDataFrame([], LIST)
        return self.spark.read.schema(LIST).parquet(f"{self.folder}/_lists/{pointer['list']}")

    def files(self) -> DataFrame:
        """(table, file, rows) of the generation read."""
        return self._files(self._pointer(self.generation()))

    def tables(self) -> list[str]:
        return sorted(self._pointer(self.generation())["schemas"])

    def _rows(self, pointer: dict, table: str, only: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(pointer["schemas"][table])
        if only is None:
            only = [r["file"] for r in self._files(pointer).filter(F.col("table") == table).select("file").collect()]
        if not only:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in only])

    def read(self, table: str, key: str = "session_id") -> DataFrame:
        """Rows of a table, without those of marked sessions."""
        pointer = self._pointer(self.generation())
        rows = self._rows(pointer, table)
        if GONE not in pointer["schemas"] or key not in rows.columns:
            return rows
        return rows.join(self._rows(pointer, GONE).select(F.col("session_id").alias(key)), key, "left_anti").select(*rows.columns)

    # --- changes ------------------------------------------------------------

    def _write(self, table: str, rows: DataFrame) -> DataFrame:
        """Data files of new rows, as rows of a list; nobody sees them yet."""
        at = f"{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{at}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{at}")
        name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
        return stored.groupBy(F.concat(F.lit(f"{at}/"), name).alias("file")).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(table).alias("table"), "file", "rows"
        )

    def commit(
        self,
        add: Mapping[str, DataFrame] | None = None,
        replace: Mapping[str, DataFrame] | None = None,
        without: DataFrame | None = None,
    ) -> int:
        """One new generation: `add` rows, `replace` whole tables, leave out the files `without(file)`."""
        before = self.generation()
        pointer = self._pointer(before)
        added, replaced = dict(add or {}), dict(replace or {})
        listed = self._files(pointer).filter(~F.col("table").isin(list(replaced)))
        if without is not None:
            listed = listed.join(without.select("file").distinct(), "file", "left_anti").select("table", "file", "rows")
        schemas = dict(pointer["schemas"])
        for table, rows in [*added.items(), *replaced.items()]:
            if table in added and table in schemas:
                rows = rows.select(*T.StructType.fromJson(schemas[table]).names)
            else:
                schemas[table] = json.loads(rows.schema.json())
            listed = listed.unionByName(self._write(table, rows))
        name = uuid.uuid4().hex
        listed.coalesce(1).sortWithinPartitions("table", "file").write.parquet(f"{self.folder}/_lists/{name}")
        return self._publish(before + 1, {"list": name, "schemas": schemas})

    def _publish(self, generation: int, pointer: dict) -> int:
        """The switch: a complete file is renamed to the generation's number, which must be free."""
        jvm = self.spark._jvm
        fs, draft = _fs(self.spark, f"{self.folder}/_drafts/{uuid.uuid4().hex}")
        _, final = _fs(self.spark, f"{self.folder}/_generations/{generation}")
        fs.mkdirs(final.getParent())
        out = fs.create(draft)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        draft, final = context.makeQualified(draft), context.makeQualified(final)
        try:
            context.rename(draft, final, self.spark._sc._gateway.new_array(rename, 0))
        except Exception as failed:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(failed):
                raise Conflict(f"generation {generation} exists") from failed
            raise
        return generation

    def _holding(self, pointer: dict, table: str, sessions: DataFrame, key: str) -> DataFrame:
        """Files of a table with rows of `sessions`; only the key column is read."""
        rows = self._rows(pointer, table).select(key, F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+/[^/]+)$", 1).alias("file"))
        mine = sessions.select(F.col("session_id").alias(key)).distinct()
        return rows.join(mine, key, "left_semi").select("file").distinct()

    def _rewrite(self, sessions: DataFrame, fresh: Mapping[str, DataFrame], key: str, clear_marks: bool) -> int:
        start = self.pin()  # a commit in between is noticed as a conflict
        pointer = start._pointer(start.generation())
        add, hit = dict(fresh), self.spark.createDataFrame([], "file string")
        for table in pointer["schemas"]:
            if table == GONE or key not in T.StructType.fromJson(pointer["schemas"][table]).names:
                continue
            held = materialise(start._holding(pointer, table, sessions, key), "generation-hit")
            names = [r["file"] for r in held.collect()]
            if names:
                rows = start._rows(pointer, table, names)
                kept = rows.join(sessions.select(F.col("session_id").alias(key)), key, "left_anti").select(*rows.columns)
                add[table] = kept.unionByName(fresh[table].select(*rows.columns)) if table in fresh else kept
                hit = hit.unionByName(held)
        gone = {GONE: start._rows(pointer, GONE).limit(0)} if clear_marks and GONE in pointer["schemas"] else {}
        return start.commit(add, gone, hit)

    def replace_sessions(self, sessions: DataFrame, fresh: Mapping[str, DataFrame], key: str = "session_id") -> int:
        """Whole sessions anew in all tables at once; only files that hold rows of them are written again."""
        return self._rewrite(sessions, fresh, key, clear_marks=False)

    def forget(self, sessions: DataFrame) -> int:
        """Mark sessions: from this generation on no reader sees them."""
        return self.commit(add={GONE: sessions.select(F.col("session_id").cast("string").alias("session_id")).distinct()})

    def compact(self, key: str = "session_id") -> int:
        """Write the files that hold marked rows anew without them, and clear the marks."""
        pointer = self._pointer(self.generation())
        if GONE not in pointer["schemas"]:
            return self.generation()
        return self._rewrite(self._rows(pointer, GONE), {}, key, clear_marks=True)

    def expire(self, keep: int = 1, grace: float = 86_400) -> int:
        """Forget all but the last `keep` generations and remove the files only they list.

        Files of no generation at all, left by writers that failed, go once
        they are older than `grace` seconds. Returns how many data files went.
        """
        numbers = self.generations()
        old, kept = numbers[:-keep], numbers[-keep:]
        expired = {r["file"] for n in old for r in self._files(self._pointer(n)).select("file").collect()}
        pointers = [self._pointer(n) for n in kept]
        live = {r["file"] for p in pointers for r in self._files(p).select("file").collect()}
        lists = {p["list"] for p in pointers}
        for n in old:  # readers lose the generation before its files
            fs, at = _fs(self.spark, f"{self.folder}/_generations/{n}")
            fs.delete(at, False)
        before, removed = (time.time() - grace) * 1000, 0
        for table in _statuses(self.spark, self.folder):
            name = table.getPath().getName()
            if name in ("_generations", "_lists", "_drafts"):
                continue
            for part in _statuses(self.spark, f"{self.folder}/{name}"):
                at = f"{name}/{part.getPath().getName()}"
                data = [s for s in _statuses(self.spark, f"{self.folder}/{at}") if s.getPath().getName().startswith("part-")]
                fs, path = _fs(self.spark, f"{self.folder}/{at}")
                stays = 0
                for s in data:
                    file = f"{at}/{s.getPath().getName()}"
                    if file not in live and (file in expired or s.getModificationTime() < before):
                        fs.delete(s.getPath(), False)
                        removed += 1
                    else:
                        stays += 1
                if not stays and (data or part.getModificationTime() < before):
                    fs.delete(path, True)
        for status in _statuses(self.spark, f"{self.folder}/_lists"):
            if status.getPath().getName() not in lists and (old or status.getModificationTime() < before):
                status_fs, at = _fs(self.spark, f"{self.folder}/_lists/{status.getPath().getName()}")
                status_fs.delete(at, True)
        return removed
