"""Micro-batch ingest equals batch, survives a restart, and drops sessions that turn private."""

import json

from pyspark.sql import functions as F

from skein.operators import sessions as S
from skein.sources import logs, sinks
from skein.sources import transcripts as R
from skein.streaming import live


def row(session, n, text, cwd="/w"):
    line = json.dumps({"type": "user", "timestamp": f"2026-01-01T00:00:{n:02d}Z", "cwd": cwd, "message": {"role": "user", "content": text}})
    return {"session_id": session, "project": "p", "source": "claude-code", "file_path": f"/{session}.jsonl", "line_no": n, "line": line}


def drain(spark, src, out, ckpt, private=None):
    q = live.start_ingest(live.line_log_stream(spark, str(src), 1), str(out), str(ckpt), private)
    q.awaitTermination()
    assert q.exception() is None


def test_stream_equals_batch_and_restarts(spark, tmp_path, write_lines):
    src, out, ckpt = tmp_path / "log", tmp_path / "out", tmp_path / "ckpt"
    write_lines(src / "1.json", [row("a", 0, "zero"), row("a", 1, "one"), row("b", 0, "bee")])
    drain(spark, src, out, ckpt)
    write_lines(src / "2.json", [row("a", 2, "two"), row("b", 1, "buzz"), row("c", 0, "sea")])
    drain(spark, src, out, ckpt)
    drain(spark, src, out, ckpt)  # nothing new
    got = live.read_messages(spark, str(out)).select("session_id", "msg_index", "user_text").collect()
    lines = spark.read.schema(live.LINE_LOG).json(str(src))
    want = R.parse_messages(lines).select("session_id", "msg_index", "user_text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 6
    cols = ["session_id", "msg_count", "first_user_prompt", "started_at", "last_msg_at"]
    have = live.read_sessions(spark, str(out)).select(cols).collect()
    assert sorted(map(tuple, have)) == sorted(map(tuple, S.session_rollup(R.parse_messages(lines)).select(cols).collect()))


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    first = spark.createDataFrame([row("a", 0, "zero")], live.LINE_LOG)
    second = spark.createDataFrame([row("a", 1, "one")], live.LINE_LOG)
    live.ingest_batch(first, 0, out)
    live.ingest_batch(second, 1, out)
    live.ingest_batch(second, 1, out)
    got = live.read_messages(spark, out).select("msg_index", "user_text").collect()
    assert sorted(map(tuple, got)) == [(0, "zero"), (1, "one")]


def test_uncommitted_rows_stay_hidden(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1)], "session_id string, n int")
    sinks.commit_batch({"t": df}, out, 0)
    df.write.parquet(f"{out}/t/batch=1")
    assert sinks.read_committed(spark, out, "t").count() == 1


def test_session_turns_private_later(spark, tmp_path):
    out = str(tmp_path / "out")
    rule = lambda m, d: S.private_sessions(m, d, ["secret diary"], ["/vault"])
    live.ingest_batch(spark.createDataFrame([row("a", 0, "fine"), row("b", 0, "fine too")], live.LINE_LOG), 0, out, rule)
    assert live.read_sessions(spark, out).count() == 2
    live.ingest_batch(spark.createDataFrame([row("a", 1, "later", "/x/vault")], live.LINE_LOG), 1, out, rule)
    assert [r.session_id for r in live.read_messages(spark, out).collect()] == ["b"]
    assert [r.session_id for r in live.read_sessions(spark, out).collect()] == ["b"]


def test_running_sessions(spark, tmp_path, write_lines):
    src = tmp_path / "messages"
    rows = [
        {"session_id": "a", "msg_index": i, "ts": f"2026-01-01 00:00:0{i}", "source": "codex", "project": "p", "cwd": None if i < 2 else "/w", "user_text": f"t{i}", "is_human_prompt": i > 0}
        for i in range(4)
    ]
    schema = "session_id string, msg_index long, ts timestamp, source string, project string, cwd string, user_text string, is_human_prompt boolean"
    write_lines(src / "1.json", rows[2:])
    write_lines(src / "2.json", rows[:2])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = live.running_sessions(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("running").first()
    assert (got.msg_count, got.first_user_prompt, got.cwd, got.started_at.second, got.last_msg_at.second) == (4, "t1", "/w", 0, 3)


def test_skill_counts(spark, tmp_path, write_lines):
    src = tmp_path / "skills"
    write_lines(
        src / "1.json",
        [{"ts": "2026-01-01T10:00:00Z", "skill_name": "x", "project_path": "/a"}, "broken {", {"ts": "never", "skill_name": "x"},
         {"ts": "2026-01-01T11:30:00Z", "skill_name": "x"}, {"ts": "2026-01-01T11:30:00Z", "skill_name": ""}],
    )
    assert logs.read_telemetry(spark, str(src)).count() == 2
    for name, window in (("all_uses", None), ("hourly", "1 hour")):
        counts = live.skill_counts(live.skill_stream(spark, str(src)), window)
        q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r.uses for r in spark.table("all_uses").collect()] == [2]
    assert [r.uses for r in spark.table("hourly").collect()] == [1, 1]


def test_rebuilds_touch_only_their_rows(spark, tmp_path):
    path = str(tmp_path / "messages")
    data = [("s1", 0, "codex", "a"), ("s2", 0, "codex", "b"), ("s3", 0, "claude-code", "c")]
    schema = "session_id string, msg_index long, source string, text string"
    sinks.write_messages(spark.createDataFrame(data, schema), path, 4)
    read = lambda: sorted((r.session_id, r.text) for r in spark.read.parquet(path).collect())
    fresh = spark.createDataFrame([("s1", 0, "codex", "A")], schema)
    sinks.rebuild_sessions(fresh, spark.createDataFrame([("s1",)], "session_id string"), path, 4)
    assert read() == [("s1", "A"), ("s2", "b"), ("s3", "c")]
    sinks.rebuild_source(spark.createDataFrame([("s9", 0, "codex", "z")], schema), path, "codex", 4)
    assert read() == [("s3", "c"), ("s9", "z")]


def test_learning_files_and_artifacts(spark, tmp_path, write_lines):
    folder = tmp_path / "learnings"
    write_lines(folder / "1.json", [json.dumps({"id": "1", "problem": "p", "created_at": "2026-01-01T00:00:00Z", "tags": ["a"]}, indent=2)])
    write_lines(folder / "2.json", ["{ corrupt"])
    got = logs.read_learnings(spark, str(folder)).collect()
    assert [(r.id, r.tags) for r in got] == [("1", ["a"])]
    sinks.write_learnings(spark.createDataFrame(got, logs.read_learnings(spark, str(folder)).schema), str(tmp_path / "copy"))
    assert spark.read.json(str(tmp_path / "copy")).count() == 1
    files = spark.createDataFrame([("2026-01-01-x.md", "line one\nline two\n")], "file_name string, body string")
    sinks.write_artifacts(files, str(tmp_path / "files"))
    assert spark.read.text(str(tmp_path / "files"), wholetext=True).filter(F.col("value").startswith("line one\nline two")).count() == 1
    sinks.write_artifacts(files, str(tmp_path / "files"))  # again: nothing doubles
    assert [r.value for r in spark.read.text(str(tmp_path / "files")).filter("value <> ''").orderBy("value").collect()] == ["line one", "line two"]
    same = spark.createDataFrame([("b", "y.md", "second"), ("a", "y.md", "first"), ("c", "z", "third")], "id string, file_name string, body string")
    sinks.write_artifacts(same, str(tmp_path / "files"), "id")
    got = {r.file_name: r.value for r in spark.read.text(str(tmp_path / "files")).filter("value NOT LIKE 'line%' AND value <> ''").collect()}
    assert got == {"y.md": "first", "y~2.md": "second", "z": "third"}
    assert spark.read.text(str(tmp_path / "files")).filter("value = 'line one'").count() == 1
    for i, end in enumerate(["window_end: 2026-01-08T00:00:00Z", "no date"]):
        write_lines(tmp_path / "w" / f"{i}.md", ["---", "window_start: 2026-01-01T00:00:00Z", end, "---"])
    assert logs.read_window_artifacts(spark, str(tmp_path / "w")).count() == 1
    write_lines(tmp_path / "posts.json", [json.dumps([{"id": 5, "text": "a", "likeCount": 2}, {"id": "6", "conversationId": 1}])])
    assert sorted(r.id for r in logs.read_posts(spark, str(tmp_path / "posts.json")).collect()) == ["5", "6"]
    doc = {"phases": {"phases": [{"phaseId": 1, "phaseName": "Set-up", "messageIndices": [0, 2], "description": "d"}], "taskBoundaries": [0]},
           "annotations": [{"messageIndex": 2, "content": "c", "annotation": "a", "color": "red", "reasoning": "r"}]}
    write_lines(tmp_path / "ann" / "s1-annotations.json", [json.dumps(doc)])
    notes, phases = logs.read_annotations(spark, str(tmp_path / "ann"))
    assert notes.first().session_id == "s1" and sorted(r.msg_index for r in phases.collect()) == [0, 2]


def test_unknown_scope_is_held_back_until_told(spark, tmp_path):
    out = str(tmp_path / "out")

    def line(n, **obj):
        return {"session_id": "x", "project": "codex", "source": R.CODEX, "file_path": "/x.jsonl", "line_no": n, "line": json.dumps({"timestamp": f"2026-01-01T00:00:{n:02d}Z", **obj})}

    said = {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hello"}]}}
    live.ingest_batch(spark.createDataFrame([line(0, **said)], live.LINE_LOG), 0, out)
    assert live.read_messages(spark, out).count() == 0 and live.read_sessions(spark, out).count() == 0
    told = {"type": "session_meta", "payload": {"cwd": "/w/here"}}
    live.ingest_batch(spark.createDataFrame([line(1, **told)], live.LINE_LOG), 1, out)
    assert [r.user_text for r in live.read_messages(spark, out).collect()] == ["hello"]
    assert [(r.cwd, r.msg_count) for r in live.read_sessions(spark, out).collect()] == [("/w/here", 1)]
