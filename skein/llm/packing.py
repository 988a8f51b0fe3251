"""Best-fit packing of tokenized documents, online and in bounded space.

Documents become pieces of at most one sequence. A packing task sees its pieces
in a random but repeatable order, and holds a fixed number of open bins. The
free space of the open bins is a bitset: the best fit of a piece is the lowest
set bit at or above its length. When there are too many open bins, the fullest
closes. Bins that are still open when a task ends go, piece by piece, through
further rounds with fewer tasks, so that few half-empty sequences remain.

Defined cases: a null text is the empty text, one piece of a single separator;
null ids and repeated rows are packed like others, each row on its own; an
empty table gives no sequence; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import kept_by_worker, pieces
from skein.session import materialise

#: tokens of a sequence
SEQUENCE = 2048
#: id put after every document
SEPARATOR = 0
#: open bins of a packing task
OPEN_BINS = 1024
#: pieces a packing task sees, on average
TASK_PIECES = 40_000
#: rounds after which all bins close; each leaves about a twentieth of its pieces to the next
ROUNDS = 8
#: words and parts whose ids a worker remembers (twice as many while it forgets)
CACHE_WORDS = 500_000

#: texts of these characters only can be cut at white space without changing any id
_PLAIN = regex.compile(r"[\n\r\t\x20-\x7e\xa1-\xac\xae-˿Ͱ-ϿЀ-ӿ‐-‧‰-⁞₠-₿]*")
#: letters whose lower case is one letter of this class, whatever stands around them
_LETTERS = "A-Za-zµÀ-ÖØ-öø-įı-ȹȻ-Ƚȿ-ʯЀ-ҁ"
#: marks that join no letter or digit
_MARKS = r"!-/:-@\[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-‧‰-⁞"
#: texts of these characters only are cut here as the tokenizer cuts them, after lower-casing
_SIMPLE = regex.compile(f"[\\n\\r\\t 0-9{_LETTERS}{_MARKS}]*")
_PART = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[{_MARKS}]+")
#: parts encoded together
TOGETHER = 128


class Ids:
    """Word, or part of one, -> its ids as little-endian unsigned 32-bit numbers.

    The tokenizer lower-cases, cuts words into runs of letters, digits and runs
    of marks, and never joins tokens across a cut. A text of simple characters is
    cut into the same parts, which many words share; other texts are cut at
    white space only. New parts are encoded together, and their character offsets
    tell whose ids are whose. When the table is full, a part stays only if it is
    met again before the table fills once more.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: tokens that the tokenizer looks for before it cuts
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def cut(self, text: str) -> list[str] | None:
        """Parts whose ids in a row are those of the text; None where it can't be cut."""
        if _SIMPLE.fullmatch(text):
            low = text.lower()
            if not any(a in low for a in self.added):
                return _PART.findall(low)
        return text.split() if _PLAIN.fullmatch(text) else None

    def learn(self, parts: set[str]) -> None:
        if len(self.known) + len(parts) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for p in parts.difference(known):
            ids = older.get(p)
            if ids is None:
                new.append(p)
            else:
                known[p] = ids
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4").tobytes()
            starts = np.fromiter((a for a, _ in found.offsets), np.int64)
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            cuts = (4 * np.searchsorted(starts, np.cumsum(lengths + 1) - lengths - 1)).tolist()
            for p, a, b in zip(some, cuts, [*cuts[1:], len(ids)], strict=True):
                known[p] = ids[a:b]

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text."""
        cut = [self.cut(t) for t in texts]
        self.learn(set().union(*(parts for parts in cut if parts)))
        for text, parts in zip(texts, cut, strict=True):
            yield self.encode(text) if parts is None else b"".join(map(self.known.__getitem__, parts))


_LOADED: dict[str, Ids] = {}
kept_by_worker(_LOADED.clear)


def loaded(path: str) -> Ids:
    """One table of words per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = np.array([separator], dtype="<u4").tobytes()
    width = 4 * sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = loaded(tokenizer)
        for batch in pieces(batches):
            rows, out = [], []
            for n, data in enumerate(ids.of([t or "" for t in batch.column(1).to_pylist()])):
                data += end
                for k, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    rows.append(n)
                    out.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                k, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


class Bins:
    """Open bins by free space; `place` gives the bin of a piece and its offset there."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.count, self.made = size, most, 0, 0
        self.bits = 0  # bit f is set when an open bin has free space f
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _open(self, number: int, free: int) -> None:
        if not free:
            return
        self.by_free[free].append(number)
        self.bits |= 1 << free
        self.count += 1
        if self.count > self.most:
            self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.made, self.size
            self.made += 1
        self._open(number, free - length)
        return number, self.size - free

    def open_bins(self) -> set[int]:
        return {n for stack in self.by_free for n in stack}


def _round(rows: DataFrame, tasks: int, number: int, last: bool, sequence: int, open_bins: int) -> DataFrame:
    """Pack `rows` in `tasks` tasks; rows of bins that stay open have no sequence unless it is the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = (number << 58) + (TaskContext.get().partitionId() << 32)
        bins = Bins(sequence, open_bins)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            held.append(pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            ))
        again = np.array(sorted(base + b for b in bins.open_bins()), dtype=np.int64)
        for batch in held:
            ids = batch.column(5).to_numpy()
            closed = np.ones(len(ids), bool) if last else ~np.isin(ids, again)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(ids, mask=~closed), batch.column(6)], batch.schema.names
            )

    dealt = rows.repartition(tasks).sortWithinPartitions(F.xxhash64("ids_crc32", "doc_id", "piece"), "doc_id", "piece")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    sequence: int = SEQUENCE,
    separator: int = SEPARATOR,
    open_bins: int = OPEN_BINS,
    task_pieces: int = TASK_PIECES,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A packing task holds its share of the piece table, about `task_pieces` narrow
    rows, until it knows which bins stay open.
    """
    rows = materialise(token_pieces(docs, tokenizer, sequence, separator), "packing-pieces")
    done, number = [], 0
    while True:
        tasks = max(1, round(rows.count() / task_pieces))
        last = tasks == 1 or number == ROUNDS - 1
        packed = materialise(_round(rows, tasks, number, last, sequence, open_bins), f"packing-{number}")
        done.append(packed if last else packed.filter("sequence_id IS NOT NULL"))
        if last:
            break
        rows = packed.filter("sequence_id IS NULL").drop("sequence_id", "offset")
        number += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
