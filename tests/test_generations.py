"""Generations over several tables: all or nothing, pinned readers, physical removal."""

import os

import pytest
from pyspark.sql import functions as F

from skein.sources.generations import Conflict, Store


def rows(spark, sessions, text="said"):
    messages = spark.createDataFrame(
        [(s, n, f"{text} {s} {n}") for s in sessions for n in range(3)], "session_id string, msg_index long, user_text string"
    )
    files = spark.createDataFrame([(s, f"/{s}/a.py") for s in sessions], "session_id string, file_path string")
    return {"messages": messages.repartition(3, "session_id"), "session_files": files.coalesce(1)}


def ids(df):
    return {r["session_id"] for r in df.select("session_id").collect()}


def data_files(folder):
    return {
        os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns
        for at, _, names in os.walk(folder)
        for f in names
        if f.startswith("part-") and "_lists" not in at
    }


def test_a_change_that_fails_between_tables_shows_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.generation() == 0 and store.tables() == []
    store.commit(rows(spark, "abc"))
    broken = rows(spark, "x")
    broken["session_files"] = broken["session_files"].withColumn("file_path", F.raise_error(F.lit("disk")).cast("string"))
    with pytest.raises(Exception, match="disk"):
        store.replace_sessions(spark.createDataFrame([("a",)], "session_id string"), broken)
    assert ids(store.read("messages")) == set("abc") == ids(store.read("session_files"))
    assert store.generations() == [1]
    # what the failed writer left behind goes once it is old
    lost = len(data_files(tmp_path))
    assert store.expire(grace=86_400) == 0 and len(data_files(tmp_path)) == lost
    assert store.expire(grace=-5) > 0
    assert ids(store.read("messages")) == set("abc")


def test_replaced_sessions_change_in_all_tables_and_readers_stay_pinned(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit(rows(spark, "abc"))
    held = store.pin()
    before = held.read("messages").filter("session_id = 'b'").count()
    store.replace_sessions(spark.createDataFrame([("b",), ("new",)], "session_id string"), rows(spark, ["b", "new"], "again"))
    got = {(r["session_id"], r["msg_index"]): r["user_text"] for r in store.read("messages").collect()}
    assert len(got) == store.read("messages").count() == 12
    assert got["b", 1] == "again b 1" and got["a", 1] == "said a 1" and got["new", 0] == "again new 0"
    assert ids(store.read("session_files")) == {"a", "b", "c", "new"} and store.read("session_files").count() == 4
    assert ids(held.read("messages")) == set("abc") and held.read("messages").filter("session_id = 'b'").count() == before == 3
    assert held.read("messages").filter("user_text LIKE 'again%'").count() == 0


def test_of_two_writers_the_second_is_told(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit(rows(spark, "a"))
    late = store.pin()
    store.commit(rows(spark, "b"))
    with pytest.raises(Conflict):
        late.commit(rows(spark, "c"))
    assert ids(store.read("messages")) == {"a", "b"} and store.generations() == [1, 2]


def test_forgotten_text_leaves_the_disk_and_other_files_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = {k: v.coalesce(1) for k, v in rows(spark, "ab").items()}
    store.commit(first | {"totals": spark.createDataFrame([(6,)], "n long").coalesce(1)})
    store.commit({k: v.coalesce(1) for k, v in rows(spark, ["secret", "d"]).items()})
    untouched = {f: t for f, t in data_files(tmp_path).items()}
    store.forget(spark.createDataFrame([("secret",), (None,), ("unknown",)], "session_id string"))
    assert ids(store.read("messages")) == {"a", "b", "d"} and store.read("totals").count() == 1
    store.compact()
    assert ids(store.read("messages")) == {"a", "b", "d"} and store.read("session_files").count() == 3
    assert store.expire() > 0
    now = data_files(tmp_path)
    for file in now:
        table = spark.read.parquet(file)
        if "session_id" in table.columns:
            assert table.filter("session_id = 'secret'").count() == 0
    of_first = [f for f in untouched if f in now]
    assert len(of_first) == 3 and all(now[f] == untouched[f] for f in of_first)  # two of the first commit and the totals
    assert ids(store.read("messages")) == {"a", "b", "d"}
    # the marks are cleared: the session may come back
    store.commit(rows(spark, ["secret"]))
    assert "secret" in ids(store.read("messages"))


def test_empty_tables_keep_their_schema(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({"messages": rows(spark, "a")["messages"].limit(0)})
    assert store.read("messages").columns == ["session_id", "msg_index", "user_text"] and store.read("messages").count() == 0
    store.compact()
    store.commit(rows(spark, "a"))
    store.commit(replace={"messages": rows(spark, "z")["messages"].withColumn("more", F.lit(1))})
    assert ids(store.read("messages")) == {"z"} and "more" in store.read("messages").columns
    store.forget(spark.createDataFrame([("z",)], "session_id string"))
    store.compact()
    assert store.read("messages").count() == 0
