"""Growing transcript trees followed as a stream equal the same trees read as a batch."""

import json
import random

import pyarrow as pa

from skein.operators import sessions as S
from skein.sources import tail
from skein.sources import transcripts as R
from skein.streaming import live


def said(n, text, cwd="/w"):
    return json.dumps({"type": "user", "timestamp": f"2026-01-01T00:{n // 60:02d}:{n % 60:02d}Z", "cwd": cwd, "message": {"role": "user", "content": text}}) + "\n"


def rollout(n, text, cwd=None):
    line = {"type": "response_item", "timestamp": f"2026-01-02T00:00:{n:02d}Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}]}}
    return json.dumps(line | ({"cwd": cwd} if cwd else {})) + "\n"


def add(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        f.write(text)


class Follower:
    def __init__(self, spark, tmp_path, **options):
        self.spark, self.roots = spark, {"claude_root": str(tmp_path / "claude"), "codex_root": str(tmp_path / "codex")}
        self.out, self.checkpoint, self.options = str(tmp_path / "out"), str(tmp_path / "ckpt"), options

    def drain(self):
        """One query from the checkpoint: each call is a restart."""
        query = live.start_ingest(live.tail_stream(self.spark, **self.roots, **self.options), self.out, self.checkpoint, chunk=live.TAIL_CHUNK)
        query.awaitTermination()
        assert query.exception() is None

    def check(self):
        cols = ["session_id", "msg_index", "source", "project", "user_text"]
        lines = R.read_lines(self.spark, self.roots["claude_root"], self.roots["codex_root"])
        batch = R.parse_messages(lines)
        placed = S.known_scope(batch, R.working_dirs(lines), R.CODEX)
        want = sorted(map(tuple, placed.select(cols).collect()))
        assert sorted(map(tuple, live.read_messages(self.spark, self.out).select(cols).collect())) == want
        cols = ["session_id", "msg_count", "first_user_prompt", "started_at", "last_msg_at", "cwd"]
        sessions = S.session_rollup(batch, R.working_dirs(lines)).filter("source = 'claude-code' OR cwd IS NOT NULL").select(cols)
        assert sorted(map(tuple, live.read_sessions(self.spark, self.out).select(cols).collect()), key=repr) == sorted(map(tuple, sessions.collect()), key=repr)
        return want


def test_both_trees_grow_shrink_and_restart(spark, tmp_path):
    f = Follower(spark, tmp_path, part_bytes=300)
    a, b = tmp_path / "claude/p/a.jsonl", tmp_path / "claude/q/b.jsonl"
    c = tmp_path / "codex/2026/01/02/c.jsonl"
    for path, make in ((a, said), (b, said), (c, rollout)):
        add(path, "".join(make(n, f"{path.stem} {n} " + "ü" * 40) for n in range(8)))
    add(tmp_path / "claude/a/deep/x.jsonl", said(0, "too deep"))
    add(tmp_path / "codex/1/2/3/4/x.jsonl", rollout(0, "too deep", "/w"))
    f.drain()
    assert len(f.check()) == 16  # the second vendor's session states no directory yet
    held = said(9, "held back")
    add(a, "not json\n\n" + said(8, "more") + held[:30])
    add(c, rollout(9, "now placed", "/w"))
    f.drain()
    assert "held back" not in str(live.read_messages(spark, f.out).collect())
    add(a, held[30:])
    add(tmp_path / "claude/p/late.jsonl", said(0, "late"))
    f.drain()
    assert len(f.check()) == 28
    b.write_text(said(50, "replaced"))  # shorter than what was read
    f.drain()
    rows = f.check()
    assert [r[-1] for r in rows if r[0] == "b"] == ["replaced"]
    a.write_text("")
    f.drain()
    add(b, said(51, "and on"))
    f.drain()
    assert not [r for r in f.check() if r[0] == "a"] and [r[1] for r in f.check() if r[0] == "b"] == [0, 1]
    add(a, said(52, "anew"))
    f.drain()
    assert [r[1] for r in f.check() if r[0] == "a"] == [0]


def test_state_reads_stay_flat(spark, tmp_path):
    f = Follower(spark, tmp_path)
    add(tmp_path / "codex/none.jsonl", "\n")
    read = []
    for n in range(9):
        add(tmp_path / f"claude/p/s{n % 3}.jsonl", said(n, f"text {n}"))
        query = live.start_ingest(live.tail_stream(spark, **f.roots), f.out, f.checkpoint, chunk=live.TAIL_CHUNK, compact_every=3)
        query.awaitTermination()
        assert query.exception() is None
        read.append(live.running_state(spark, f.out).count() and len(live.state_inputs(spark, f.out)))
    assert max(read[5:]) <= max(read[:5]) <= 6
    assert len(f.check()) == 9


def test_every_line_is_in_one_span():
    rng = random.Random(1)
    for _ in range(200):
        lines = [bytes(rng.choices(b"ab", k=rng.randrange(6))) for _ in range(rng.randrange(12))]
        data = b"".join(x + b"\n" for x in lines) + b"unfinished"
        whole = len(data) - len(b"unfinished")
        assert tail.last_break(pa.BufferReader(data), 0, len(data)) == whole
        cut = rng.choice([i + 1 for i, x in enumerate(data[:whole]) if x == 10] or [0])
        got = []
        for before, after in (([0, 0, 0], [cut, 1, 0]), ([cut, 1, 0], [whole, 2, 0])):
            for span in tail.spans("s", "p", before, after, rng.randrange(1, 9)):
                got += tail.lines_of(pa.BufferReader(data), span)
        starts, at = [], 0
        for x in lines:
            starts.append((at, x))
            at += len(x) + 1
        assert got == starts


def test_shards_split_a_tree(tmp_path):
    for n in range(20):
        add(tmp_path / f"p/s{n}.jsonl", "{}\n")
    parts = [json.loads(tail.TailReader({"claude_root": str(tmp_path), "shard": str(k), "shards": "3"}).latestOffset()["files"]) for k in range(3)]
    assert sorted(name for part in parts for name in part) == sorted(f"claude-code/p/s{n}.jsonl" for n in range(20))
    assert all(len(part) < 20 for part in parts)
