"""Reading both vendors' files: what is kept, how it is numbered, what is left out."""

from pyspark.sql import functions as F

from skein.functions import content as C
from skein.operators import sessions as S
from skein.sources import transcripts as R

TS = "2026-10-05T12:00:00Z"


def user(text, **extra):
    return {"type": "user", "timestamp": TS, "cwd": "/work/a", "message": {"role": "user", "content": text}, **extra}


def assistant(blocks, **extra):
    return {"type": "assistant", "timestamp": TS, "message": {"role": "assistant", "model": "m-1", "content": blocks}, **extra}


def call(name, **fields):
    return {"type": "tool_use", "id": "t1", "name": name, "input": fields}


def item(role, text, channel=None, kind="message"):
    block = "input_text" if role == "user" else "output_text"
    payload = {"type": kind, "role": role, "channel": channel, "content": [{"type": block, "text": text}]}
    return {"timestamp": TS, "type": "response_item", "payload": payload}


def meta(cwd, kind="session_meta"):
    return {"timestamp": TS, "type": kind, "payload": {"cwd": cwd}}


def claude_rows():
    return [
        {"type": "summary", "summary": "A short title"},
        user("ignored reminder", isMeta=True),
        user("Please fix the build"),
        assistant([{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "On it."}, call("Read", file_path="src/a.ts")]),
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "boom"}]}},
        "not json {",
        "",
        assistant([call("Grep", pattern="foo", path="src"), call("NotebookEdit", notebook_path="n.ipynb")]),
        {"type": "file-history-snapshot", "messageId": "x"},
        user([{"type": "text", "text": "first"}, {"type": "text", "text": "second"}]),
        user("   "),
        assistant([]),
        {"type": "user", "message": {"role": "user", "content": "[not an array]"}},
    ]


def test_vendor1_messages(spark, tmp_path, write_lines):
    write_lines(tmp_path / "projA" / "s1.jsonl", claude_rows())
    write_lines(tmp_path / "projA" / "deep" / "skipped.jsonl", [user("too deep")])
    m = R.parse_messages(R.read_claude_lines(spark, str(tmp_path)), [R.CLAUDE]).orderBy("msg_index").collect()
    assert [r.msg_index for r in m] == list(range(6))
    assert {(r.session_id, r.project, r.source) for r in m} == {("s1", "projA", "claude-code")}
    assert m[1].user_text == "Please fix the build" and m[1].is_human_prompt
    assert m[2].assistant_text == "On it." and m[2].file_paths == ["src/a.ts"]
    assert m[2].tool_calls[0].preview == '{"file_path":"src/a.ts"}'
    assert m[3].assistant_text == "" and m[3].file_paths == ["src", "foo", "n.ipynb"]
    assert m[4].user_text == "first\nsecond"
    assert m[5].user_text == "[not an array]" and m[5].ts is None
    assert not any("boom" in str(r) for r in m)


def test_discovery_and_metadata(spark, tmp_path, write_lines):
    path = write_lines(tmp_path / "projA" / "s1.jsonl", claude_rows())
    lines = R.read_claude_lines(spark, str(tmp_path))
    found = R.discover_sessions(lines).collect()
    assert len(found) == 1 and found[0].first_message == "ignored reminder"
    assert found[0].size == path.stat().st_size and found[0].line_count == 13
    entries = R.parse_claude_entries(lines)
    head = R.conversation_metadata(entries).first()
    assert (head.summary, head.first_prompt) == ("A short title", "Please fix the build")
    assert R.first_model(entries).first().model == "m-1"


def test_line_numbers_follow_the_file_across_splits(spark, tmp_path, write_lines):
    write_lines(tmp_path / "p" / "big.jsonl", [user(f"message number {i} " + "x" * 200) for i in range(3000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        m = R.parse_messages(R.read_claude_lines(spark, str(tmp_path)), [R.CLAUDE])
        wrong = m.filter(~F.col("user_text").startswith(F.concat(F.lit("message number "), F.col("msg_index"), F.lit(" "))))
        assert m.count() == 3000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def codex_rows():
    return [
        meta("/projects/firm"),
        item("user", "Help me fix the backup reader."),
        {"timestamp": TS, "type": "event_msg", "payload": {"type": "user_message", "message": "Help me fix the backup reader."}},
        item("assistant", "I will look at the records first.", "commentary"),
        item("assistant", "HIDDEN thought", "analysis"),
        item("developer", "HIDDEN rules"),
        {"timestamp": TS, "type": "response_item", "payload": {"type": "function_call_output", "output": "HIDDEN tool"}},
        item("assistant", "The reader keeps timestamps now.", "final"),
    ]


def test_vendor2_rollout(spark, tmp_path, write_lines):
    write_lines(tmp_path / "2026" / "01" / "02" / "rollout-x.jsonl", codex_rows())
    write_lines(tmp_path / "2026" / "01" / "02" / "03" / "too-deep.jsonl", codex_rows())
    lines = R.read_codex_lines(spark, str(tmp_path))
    m = R.parse_messages(lines, [R.CODEX]).orderBy("msg_index").collect()
    assert [(r.session_id, r.msg_index, r.project) for r in m] == [("rollout-x", i, "codex") for i in range(3)]
    assert "HIDDEN" not in str(m)
    assert [r.cwd for r in R.working_dirs(lines).collect()] == ["/projects/firm"]


def test_vendor2_legacy_events(spark, tmp_path, write_lines):
    write_lines(
        tmp_path / "old.jsonl",
        [
            {"timestamp": TS, "type": "turn.started", "text": "  start here  "},
            {"created_at": TS, "event": "item.call", "tool": {"name": "edit", "args": {"file_path": "a.py"}}},
            {"timestamp": TS, "type": "turn.completed", "payload": {"message": "done"}},
            {"timestamp": TS, "role": "user", "turn_context": {"cwd": "/w"}, "content": "by role"},
            {"timestamp": TS, "type": "item.empty"},
            {"timestamp": TS, "type": "user_input", "text": "  "},
        ],
    )
    m = R.parse_messages(R.read_codex_lines(spark, str(tmp_path)), [R.CODEX]).orderBy("msg_index").collect()
    assert [r.user_text or r.assistant_text for r in m] == ["start here", "", "done", "by role"]
    assert m[1].tool_calls[0].name == "edit" and m[1].file_paths == ["a.py"] and m[1].ts is not None
    assert m[3].cwd == "/w"


def test_scope_rules(spark, tmp_path, write_lines):
    write_lines(tmp_path / "plain.jsonl", codex_rows())
    write_lines(tmp_path / "by-dir.jsonl", [meta("/projects/vault"), item("user", "quiet words")])
    late = {"timestamp": TS, "type": "event_msg", "payload": {"text": "x" * (2 << 20)}}
    write_lines(
        tmp_path / "late.jsonl",
        [meta("/projects/firm"), item("user", "was fine"), late, meta("/projects/vault", "turn_context"), item("user", "late words")],
    )
    write_lines(tmp_path / "by-text.jsonl", [meta("/p"), item("user", "open the vault diary"), item("assistant", "ok then", "final")])
    write_lines(tmp_path / "legacy.jsonl", [{"timestamp": TS, "type": "user_input", "turn_context": {"cwd": "/x/vault"}, "text": "old"}])
    write_lines(tmp_path / "unknown.jsonl", [item("user", "nowhere")])
    lines = R.read_codex_lines(spark, str(tmp_path))
    messages, dirs = R.parse_messages(lines, [R.CODEX]), R.working_dirs(lines)
    private = S.private_sessions(messages, dirs, ["vault diary"], [r"(?:^|/)vault(?:/|$)"])
    assert {r.session_id for r in private.collect()} == {"by-dir", "late", "by-text", "legacy"}
    kept = S.without_sessions(S.known_scope(messages, dirs, R.CODEX), private)
    assert {r.session_id for r in kept.collect()} == {"plain"}


def test_incremental_append_and_replacement(spark, tmp_path, write_lines):
    path = write_lines(tmp_path / "s.jsonl", codex_rows())
    lines = R.read_codex_lines(spark, str(tmp_path))
    first = R.parse_messages(lines, [R.CODEX])
    cursor = lines.groupBy("file_path").agg((F.max("line_no") + 1).alias("lines_seen"), F.max("file_size").alias("size"))
    cursor = spark.createDataFrame(cursor.collect(), cursor.schema)
    rollup = S.finish_rollup(S.merge_rollups(S.partial_rollup(first)))
    rollup = spark.createDataFrame(rollup.collect(), rollup.schema)
    assert S.new_lines(R.read_codex_lines(spark, str(tmp_path)), cursor).count() == 0
    write_lines(path, [*codex_rows(), item("user", "One more thing.")])
    fresh = S.continue_numbering(
        R.parse_messages(S.new_lines(R.read_codex_lines(spark, str(tmp_path)), cursor), [R.CODEX]), rollup
    ).collect()
    assert [(r.msg_index, r.user_text) for r in fresh] == [(3, "One more thing.")]
    write_lines(path, codex_rows()[:2])
    replaced = S.replaced_files(R.read_codex_lines(spark, str(tmp_path)), cursor).collect()
    assert [r.session_id for r in replaced] == ["s"]
    path.write_text("")
    assert S.replaced_files(R.read_codex_lines(spark, str(tmp_path)), cursor).count() == 0
    emptied = S.replaced_files(R.list_files(spark, str(tmp_path)), cursor).collect()
    assert [r.session_id for r in emptied] == ["s"]


def test_session_directory_comes_from_any_line(spark, tmp_path, write_lines):
    write_lines(tmp_path / "s.jsonl", [item("user", "early"), meta("/work/place"), item("assistant", "done", "final"), meta("/other")])
    write_lines(tmp_path / "bare.jsonl", [item("user", "nowhere")])
    write_lines(tmp_path / "quiet.jsonl", [meta("/quiet")])
    lines = R.read_codex_lines(spark, str(tmp_path))
    messages, dirs = R.parse_messages(lines, [R.CODEX]), R.working_dirs(lines)
    got = {r.session_id: (r.cwd, r.msg_count) for r in S.session_rollup(messages, dirs).collect()}
    assert got == {"s": ("/work/place", 2), "bare": (None, 1)}
    parts = [
        S.partial_rollup(messages.filter(c), dirs.filter(c)) for c in ("line_no >= 2", "line_no < 2")
    ]
    merged = S.finish_rollup(S.merge_rollups(parts[0].unionByName(parts[1])))
    assert {r.session_id: (r.cwd, r.msg_count) for r in merged.collect()} == got


def test_unterminated_line_is_held_back(spark, tmp_path, write_lines):
    path = write_lines(tmp_path / "s.jsonl", ["one", "two", "thr"], end="")
    rows = R.read_complete_lines(spark, str(path)).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == [(0, "one"), (1, "two")]


def test_content_text_forms(spark):
    rows = spark.createDataFrame(
        [(["""{"type":"text","text":"a"}""", """{"type":"text","text":"b"}""", "junk"], None), (None, "plain"), (None, None)],
        "e array<string>, plain string",
    ).select(C.blocks_of(F.col("e")).alias("b"), "plain")
    out = rows.select(C.text_of(F.col("b"), F.col("plain")).alias("t"), C.text_or_sentinel(F.col("b"), F.col("plain")).alias("s")).collect()
    assert [tuple(r) for r in out] == [("a\nb", "a b"), ("plain", "plain"), ("", "[no text content]")]


def test_rendered_blocks(spark, tmp_path, write_lines):
    from skein.operators import timeline as L

    write_lines(tmp_path / "projA" / "s1.jsonl", claude_rows())
    entries = R.parse_claude_entries(R.read_claude_lines(spark, str(tmp_path))).withColumn("message_no", F.col("line_no"))
    rows = L.transcript_blocks(entries, text_cap=8, output_cap=2).orderBy("message_no", "block_no").collect()
    got = [(r.message_no, r.label, r.body, r.is_error) for r in rows]
    assert (2, "", "Please f...[truncated]", False) in got
    assert (3, "Tool: Read", '{"file_path":"src/a.ts"}', False) in got
    assert (4, "Tool Result (t1)", "bo...[truncated]", True) in got
    assert not any("hm" == r.body for r in rows)
