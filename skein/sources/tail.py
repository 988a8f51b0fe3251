"""Transcript files that keep growing, as a stream of their lines.

Spark's file source takes each file once. This source follows every file of both
vendors' trees: its offset is a map from file to the bytes read of it, its
modification time and how often it has begun anew. A batch holds the whole lines that were
appended since the last offset, cut into byte ranges of `part_bytes`, so one large
file is read by many tasks. Text after the last line break waits for its end.

A file that is now shorter than what was read of it was truncated or replaced: it is
read again from its start, and a row without a line announces the new beginning, so
that earlier rows of the session can be dropped even when the file is empty now.

`line_no` is the byte at which a line starts. It orders the lines of a file as
line numbers do, and no task has to know how many lines came before.

An offset takes about a hundred bytes per file. Trees of millions of files are
followed by several queries, each with `shards` and its own `shard`.

    spark.dataSource.register(TranscriptTail)
    lines = spark.readStream.format("transcript_tail").option("claude_root", root).load()
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from skein.sources.transcripts import CLAUDE, CODEX, CODEX_DEPTH, CODEX_PROJECT

SCHEMA = "session_id string, project string, source string, file_path string, line_no bigint, line string"
PART_BYTES = 64 << 20
BLOCK = 1 << 20

_ARROW = pa.schema([
    ("session_id", pa.string()), ("project", pa.string()), ("source", pa.string()),
    ("file_path", pa.string()), ("line_no", pa.int64()), ("line", pa.string()),
])

#: bytes read, modification time, times begun anew
State = list


@dataclass
class Span(InputPartition):
    """Lines of a file that start in [start, stop); `first` bytes are known to start one. No bytes: a new beginning."""

    source: str
    path: str
    first: int
    start: int
    stop: int
    anew: bool = False


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


def list_tree(root: str, source: str) -> dict[str, fs.FileInfo]:
    """Transcript files below `root`, by path relative to it."""
    system, base = open_root(root)
    base = base.rstrip("/")
    found = {}
    for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        name = info.path[len(base) + 1 :]
        depth = name.count("/")
        if info.is_file and name.endswith(".jsonl") and (depth == 1 if source == CLAUDE else depth <= CODEX_DEPTH):
            found[name] = info
    return found


def last_break(handle: pa.NativeFile, start: int, size: int) -> int:
    """Byte after the last line break in [start, size), `start` if there is none; reads backwards."""
    stop = size
    while stop > start:
        at = max(start, stop - BLOCK)
        handle.seek(at)
        found = handle.read(stop - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        stop = at
    return start


def advance(known: State | None, info: fs.FileInfo, handle) -> State:
    """State of a file after its present whole lines; `handle()` opens it."""
    read, seen, begun = known or [0, -1, 0]
    now = info.mtime_ns
    if info.size < read:
        read, begun = 0, begun + 1
    elif info.size == read or known and now == seen:
        return [read, now, begun]
    with handle() as f:
        return [last_break(f, read, info.size), now, begun]


def spans(source: str, path: str, before: State | None, after: State, part_bytes: int) -> Iterator[Span]:
    """Byte ranges between two states of a file."""
    read, _, begun = before or [0, -1, 0]
    if after[2] != begun:
        yield Span(source, path, 0, 0, 0, True)
        read = 0
    for start in range(read, after[0], part_bytes):
        yield Span(source, path, read, start, min(start + part_bytes, after[0]))


def lines_of(handle: pa.NativeFile, span: Span) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of every line that starts in the span, without its line break."""
    at = span.start
    if span.start > span.first:  # the line over the border belongs to the span before
        handle.seek(span.start - 1)
        at -= 1
    else:
        handle.seek(at)
    skip, rest, pos = span.start > span.first, b"", at
    while True:
        block = handle.read(BLOCK)
        if not block:
            return
        *whole, rest_now = (rest + block).split(b"\n")
        for line in whole:
            if skip:
                skip = False
            elif pos >= span.stop:
                return
            else:
                yield pos, line.removesuffix(b"\r")
            pos += len(line) + 1
        rest = rest_now
        if pos >= span.stop and not skip:
            return


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots = {s: options[k] for s, k in ((CLAUDE, "claude_root"), (CODEX, "codex_root")) if options.get(k)}
        if not self.roots:
            raise ValueError("name at least one root")
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.shard, self.shards = int(options.get("shard", 0)), int(options.get("shards", 1))
        self.last: dict[str, State] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        files: dict[str, State] = {}
        for source, root in self.roots.items():
            system, _ = open_root(root)
            for name, info in list_tree(root, source).items():
                key = f"{source}/{name}"
                if zlib.crc32(key.encode()) % self.shards == self.shard:
                    files[key] = advance(self.last.get(key), info, lambda path=info.path, system=system: system.open_input_file(path))
        # a file that has gone keeps its state: it counts as begun anew if it comes back shorter
        self.last = {**self.last, **files}
        return {"files": json.dumps(self.last, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        if not self.last:  # a restarted query goes on from the offsets in its checkpoint
            self.last = after
        out = []
        for key, state in after.items():
            if before.get(key) != state:
                source, name = key.split("/", 1)
                out += spans(source, name, before.get(key), state, self.part_bytes)
        return out

    def commit(self, end: dict) -> None:
        self.last = {**json.loads(end["files"]), **self.last}

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        root = self.roots[partition.source]
        system, base = open_root(root)
        name = partition.path.rsplit("/", 1)[-1].removesuffix(".jsonl")
        project = partition.path.split("/", 1)[0] if partition.source == CLAUDE else CODEX_PROJECT
        path = f"{root.rstrip('/')}/{partition.path}"

        def rows(found: list[tuple[int, str | None]]) -> pa.RecordBatch:
            n = len(found)
            fixed = [pa.array([x] * n, pa.string()) for x in (name, project, partition.source, path)]
            return pa.RecordBatch.from_arrays([*fixed, pa.array([p for p, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], schema=_ARROW)

        if partition.anew:
            yield rows([(-1, None)])
            return
        found, size = [], 0
        with system.open_input_file(f"{base.rstrip('/')}/{partition.path}") as handle:
            for pos, line in lines_of(handle, partition):
                found.append((pos, line.decode("utf-8", "replace")))
                size += len(line)
                if size > 4 * BLOCK or len(found) == 10_000:
                    yield rows(found)
                    found, size = [], 0
        if found:
            yield rows(found)


class TranscriptTail(DataSource):
    """Options: claude_root, codex_root (at least one), part_bytes, shard, shards."""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailReader(dict(self.options))
