from skein.operators.tools import phase_rollup


def test_ranges_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    kind = "session_id string, phase_no long, name string, start long, end long"
    ranges = spark.createDataFrame([("a", 1, "Phase 1", 1, 3), ("a", 2, "Phase 2", 3, 600)], kind).mapInArrow(count, kind)
    calls = spark.createDataFrame(
        [("a", 2, "Write", "x"), ("a", 3, "Edit", "x"), ("a", 500, "Edit", "y")], "session_id string, msg_index long, tool string, file_path string"
    )
    talk = spark.sql("SELECT 'a' AS session_id, id AS msg_index, timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts FROM range(4)")
    got = {r["phase_no"]: r for r in phase_rollup(calls, talk, ranges).collect()}
    assert seen.value == 2
    assert [got[1][c] for c in ("message_count", "duration_minutes", "files_created", "files_modified", "tools_used")] == [3, 2, 1, 1, "Edit: 1x, Write: 1x"]
    assert [got[2][c] for c in ("message_count", "duration_minutes", "files_created", "files_modified", "tools_used")] == [1, 0, 0, 2, "Edit: 2x"]
