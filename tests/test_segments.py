"""An index that grows, shrinks and merges scores like one built afresh."""

import os
from pathlib import Path

import pytest

from skein.operators import search as Q
from skein.operators import segments

TERMS = ["red", "blue", "fox"]


def messages(spark, rows):
    table = [(s, i, text, "", "", "") for s, i, text in rows]
    return spark.createDataFrame(table, "session_id string, msg_index long, user_text string, assistant_text string, tool_calls string, file_paths string")


def scores(index):
    return {(r["session_id"], r["msg_index"]): round(r["score"], 9) for r in Q.bm25(index, TERMS).collect()}


def fresh(spark, rows):
    return scores(Q.build_index(messages(spark, rows), stem=False))


def text(n):
    return " ".join(w for w, every in (("red", 2), ("blue", 3), ("fox", 7), ("dog", 1)) if n % every == 0) + f" filler{n}" * (n % 5)


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_append_delete_merge_equal_a_fresh_index(spark, tmp_path):
    folder, rows = str(tmp_path / "index"), [(f"s{n % 9}", n, text(n)) for n in range(60)]
    for lo in range(0, 60, 20):
        before = files(folder)
        segments.append(messages(spark, rows[lo : lo + 20]), folder, stem=False)
        assert before.items() <= files(folder).items()
        assert len({p.split("/segments/")[1][:32] for p in set(files(folder)) - set(before) if "/segments/" in p}) == 1
        assert scores(segments.read(spark, folder)) == fresh(spark, rows[: lo + 20])
    old = segments.versions(spark, folder)[-1]
    segments.delete(spark.createDataFrame([("s1",), ("s2",), ("nobody",)], "session_id string"), folder)
    segments.delete(spark.createDataFrame([("s3", 3), ("s3", 12), ("s1", 1)], "session_id string, msg_index long"), folder)
    left = [r for r in rows if r[0] not in ("s1", "s2") and r[:2] not in (("s3", 3), ("s3", 12))]
    assert scores(segments.read(spark, folder)) == fresh(spark, left)
    assert scores(segments.read(spark, folder, old)) == fresh(spark, rows)
    segments.append(messages(spark, [("s1", 1, "red again")]), folder, stem=False)
    left.append(("s1", 1, "red again"))
    assert scores(segments.read(spark, folder)) == fresh(spark, left)
    segments.merge(spark, folder, fan=2)
    now = segments._rows(spark, folder)[1]
    assert len(now) < 4 and sum(r["docs"] for r in now) == len(left)
    assert scores(segments.read(spark, folder)) == fresh(spark, left)
    swapped = [(s, i, "blue fox " + t) if s == "s4" else (s, i, t) for s, i, t in left]
    segments.replace(messages(spark, [r for r in swapped if r[0] == "s4"]), spark.createDataFrame([("s4",)], "session_id string"), folder, stem=False)
    assert scores(segments.read(spark, folder)) == fresh(spark, swapped)
    segments.vacuum(spark, folder, keep=1)
    assert scores(segments.read(spark, folder)) == fresh(spark, swapped)
    assert len(segments.versions(spark, folder)) == 1
    segments.rebuilt(spark, folder, str(tmp_path / "other"))
    assert scores(segments.read(spark, str(tmp_path / "other"))) == fresh(spark, swapped)


def test_deletions_are_broadcast_by_their_number(spark, tmp_path, monkeypatch):
    folder, rows = str(tmp_path / "index"), [(f"s{n % 9}", n, text(n)) for n in range(60)]
    segments.append(messages(spark, rows), folder, stem=False)
    segments.delete(spark.createDataFrame([("s1",), ("s2",)], "session_id string"), folder)  # 14 messages in a few KB
    left = [r for r in rows if r[0] not in ("s1", "s2")]
    for most, join in ((14, "BroadcastHashJoin"), (13, "SortMergeJoin")):
        monkeypatch.setattr(segments, "BROADCAST_ROWS", most)
        for part in ("docs", "postings"):
            kept = segments._alive(spark, folder, segments._rows(spark, folder)[1], part)
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert [line.split()[1] for line in plan.splitlines() if "LeftAnti" in line] == [join]
        assert scores(segments.read(spark, folder)) == fresh(spark, left)
    segments.replace(messages(spark, [("s3", 3, "red dog")]), spark.createDataFrame([("s3",)], "session_id string"), folder, stem=False)
    left = [r for r in left if r[0] != "s3"] + [("s3", 3, "red dog")]
    assert scores(segments.read(spark, folder)) == fresh(spark, left)
    segments.rebuilt(spark, folder, str(tmp_path / "other"))
    assert scores(segments.read(spark, str(tmp_path / "other"))) == fresh(spark, left)


def test_a_writer_that_comes_second_fails(spark, tmp_path):
    folder = str(tmp_path / "index")
    segments.append(messages(spark, [("a", 0, "red")]), folder, stem=False)
    version, rows = segments._rows(spark, folder)
    segments.append(messages(spark, [("b", 0, "red blue")]), folder, stem=False)
    with pytest.raises(Exception, match="already exists"):
        segments._commit(spark, folder, version, rows)
    assert len(scores(segments.read(spark, folder))) == 2


def test_size_classes():
    rows = [{"segment": str(n), "docs": d, "dead": 0} for n, d in enumerate([1, 1, 3, 9, 10, 11, 100])]
    assert sorted([r["docs"] for r in g] for g in segments.to_merge(rows, 3)) == [[9, 10, 11]]
    assert segments.to_merge([{"segment": "x", "docs": 2, "dead": 5}], 3) == [[{"segment": "x", "docs": 2, "dead": 5}]]


def test_nothing_left(spark, tmp_path):
    folder = str(tmp_path / "index")
    with pytest.raises(ValueError, match="no message"):
        segments.read(spark, folder)
    segments.append(messages(spark, [("a", 0, "red")]), folder, stem=False)
    segments.delete(spark.createDataFrame([("a",)], "session_id string"), folder)
    with pytest.raises(ValueError, match="no message"):
        segments.read(spark, folder)
    segments.append(messages(spark, [("a", 0, "blue")]), folder, stem=False)
    assert set(scores(segments.read(spark, folder))) == {("a", 0)}
    assert os.path.isdir(f"{folder}/versions")
