"""Token counts that follow edits.

Each document keeps a segment tree over groups of pre-tokens: a leaf has the
length and the token count of its group, an inner node the sums of its subtree.
An edit re-encodes the leaves it touches and the context around them: it starts
at a leaf that the change cannot reach (the pre-token pattern looks at most two
characters past the end of a match) and goes on until a match ends where an old leaf
began, from where on the old matches hold. Only the path sums above the new
leaves change.

The trees are a table, so a log of edits can be joined to them and the result
stored as the next state.

Defined cases: a null text is the empty text with no tokens; edits with null
fields count as position 0, no deletion, no insertion; positions past the end
are moved to the end; null edits are no edits; null ids and repeated rows are
counted each on its own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import pieces

#: pre-tokens of a fresh leaf
LEAF = 32
#: characters past the end of a pre-token that its pattern may look at
REACH = 2
#: pre-tokens a worker remembers
CACHE_WORDS = 500_000


class Counter(dict):
    """Pre-token -> number of its tokens, and the pattern that cuts pre-tokens."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, part: str) -> int:
        n = len(self.encoding.encode_ordinary(part))
        if len(part) <= 48:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[part] = n
        return n

    def groups(self, parts: list[str], size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and token counts of groups of `size` pre-tokens."""
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, len(parts), size)
        chars = np.fromiter(map(len, parts), np.int64, len(parts))
        tokens = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        return np.add.reduceat(chars, at), np.add.reduceat(tokens, at)


_LOADED: dict[tuple, Counter] = {}


def loaded(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Counter(path, pattern)
    return _LOADED[path, pattern]


class Tree:
    """Sums of characters and tokens in heap order: node n has the children 2n and 2n + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        """From leaves."""
        self.size = 1 << max(0, (len(chars) - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        for heap, leaves in ((self.chars, chars), (self.tokens, tokens)):
            heap[self.size : self.size + len(leaves)] = leaves
            width = self.size
            while width > 1:
                heap[width // 2 : width] = heap[width : 2 * width].reshape(-1, 2).sum(axis=1)
                width //= 2

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> Tree:
        """From stored heaps."""
        tree = cls.__new__(cls)
        tree.size = len(chars) // 2
        tree.chars, tree.tokens = np.array(chars, np.int64), np.array(tokens, np.int64)
        return tree

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins; the last non-empty one past the end."""
        node, start = 1, 0
        position = min(position, int(self.chars[1]) - 1)
        while node < self.size:
            node *= 2
            left = int(self.chars[node])
            if position - start >= left:
                start += left
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> int:
        """Set a leaf and the sums above it; returns the nodes written."""
        node, written = leaf + self.size, 1
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        self.chars[node], self.tokens[node] = chars, tokens
        while node > 1:
            node //= 2
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            written += 1
        return written


class Document:
    """A text and its tree."""

    def __init__(self, text: str, counter: Counter, tree: Tree | None = None):
        self.text, self.counter = text, counter
        self.tree = tree or Tree(*counter.groups(counter.pattern.findall(text)))
        self.recoded = self.written = 0

    def edit(self, position: int, delete: int, insert: str) -> None:
        """Replace `delete` characters at `position`."""
        size = len(self.text)
        position = min(max(0, position), size)
        delete = min(max(0, delete), size - position)
        if not delete and not insert:
            return
        tree = self.tree
        self.text = self.text[:position] + insert + self.text[position + delete :]
        first, start = tree.leaf_at(max(0, position - REACH)) if size else (0, 0)
        changed, moved = position + len(insert), len(insert) - delete
        # old leaf ends from here on, moved to where they are now
        last, end = first, start
        parts, at = [], start
        synced = False
        for m in self.counter.pattern.finditer(self.text, start):
            parts.append(m.group())
            at = m.end()
            while last < tree.size and (end + moved < at or end < position + delete):
                end += int(tree.chars[tree.size + last])
                last += 1
            if at >= changed and end + moved == at and end >= position + delete:
                synced = True
                break
        if not synced:
            last = tree.size
        # a leaf may grow to twice its first size before the leaves are dealt anew
        fits = len(parts) <= 2 * LEAF * (last - first)
        chars, tokens = self.counter.groups(parts, max(LEAF, -(-len(parts) // (last - first))) if fits else LEAF)
        self.recoded += at - start
        if not fits:  # leaves move, nothing else is encoded
            chars, tokens = (
                np.concatenate([heap[tree.size : tree.size + first], new, heap[tree.size + last :]])
                for heap, new in ((tree.chars, chars), (tree.tokens, tokens))
            )
            self.tree = Tree(chars[chars > 0], tokens[chars > 0])
            self.written += 2 * self.tree.size
            return
        for leaf in range(first, last):
            k = leaf - first
            new = (int(chars[k]), int(tokens[k])) if k < len(chars) else (0, 0)
            if new != (tree.chars[tree.size + leaf], tree.tokens[tree.size + leaf]):
                self.written += tree.put(leaf, *new)

    @property
    def tokens(self) -> int:
        return int(self.tree.tokens[1])


def build_trees(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, text, chars, tokens: every text with the heaps of its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(vocabulary, pattern)
        for batch in pieces(batches):
            trees = [Document(t or "", counter).tree for t in batch.column(1).to_pylist()]
            heaps = [pa.array([getattr(t, name) for t in trees], pa.list_(pa.int64())) for name in ("chars", "tokens")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *heaps], ["doc_id", "text", "chars", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, chars array<long>, tokens array<long>")


def apply_edits(trees: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The next state of `trees` with a column `edits`, array of (position, delete, insert), applied in order.

    Adds tokens_before, tokens_after, chars_recoded (characters that were
    encoded again) and nodes_written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(vocabulary, pattern)
        for batch in pieces(batches):
            out: list[tuple] = []
            for row in batch.to_pylist():
                doc = Document(row["text"] or "", counter, Tree.of(row["chars"], row["tokens"]))
                before = doc.tokens
                for e in row["edits"] or ():
                    if e:
                        doc.edit(e["position"] or 0, e["delete"] or 0, e["insert"] or "")
                out.append((doc.text, doc.tree.chars, doc.tree.tokens, before, doc.tokens, doc.recoded, doc.written))
            text, chars, tokens, *numbers = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text, pa.string()), pa.array(chars, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64())), *(pa.array(n, pa.int64()) for n in numbers)],
                ["doc_id", "text", "chars", "tokens", "tokens_before", "tokens_after", "chars_recoded", "nodes_written"],
            )

    kind = trees.schema["doc_id"].dataType.simpleString()
    return trees.select("doc_id", "text", "chars", "tokens", "edits").mapInArrow(
        run,
        f"doc_id {kind}, text string, chars array<long>, tokens array<long>, "
        "tokens_before long, tokens_after long, chars_recoded long, nodes_written long",
    )


def sample_edits():
    """Three edits of a text, from its own characters: an insertion, a deletion, a replacement."""
    n = F.length(F.coalesce("text", F.lit("")))
    spot = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n.cast("long") + 1).cast("int")
    cut = lambda k, size: F.substr(F.coalesce("text", F.lit("")), spot(k) + 1, F.lit(size))
    edit = lambda position, delete, insert: F.struct(
        position.alias("position"), F.lit(delete).alias("delete"), insert.alias("insert")
    )
    return F.array(edit(spot(1), 0, cut(2, 40)), edit(spot(3), 25, F.lit("")), edit(spot(4), 12, cut(5, 12)))
