"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items become TF-IDF vectors over hashed words; words in
a large share of all documents are left out. A randomised SVD gives the latent
space: its range finder starts from the items' own rows and from a Gaussian
sketch of the passages of all documents, which tasks multiply out and Spark sums; the same
sketch gives their inner products in that range (Nystroem's form), so one pass suffices. Every
passage (overlapping windows of content words) of every document is then
compared in that space with all items of which the document has words enough to hold them;
a long item is cut into passages too. Candidates
are checked by the longest common subsequence of the item's words with a stretch of
the text sized by the item's length (items of up to `SHORT` content words wherever enough
of these stand close together, whatever the cosine), and, when that is only middling, by whether the
item's answer (its last sentence) is there as well.

Document frequencies cover all documents, discounted where a word is nearly always
followed by the same one, as in the copies of a passage. The sketch covers all documents too and serves
all items; `fit_docs` bounds it for callers who want that. Items are
processed in blocks of `BLOCK`, each with its own basis, so a larger benchmark
costs more passes and never a larger broadcast: the hits of a block are written before the next.

Defined cases: null or empty texts and items match nothing; a null doc_id is
returned as null; repeated rows are each returned; an item without enough content words
is compared by all its words, nearly all of which must stand close together; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded, forget_tables, fresh, kept_by_worker, pieces, sampled
from skein.session import gathered, materialise, shared_folder, write

#: hashed words of the vector space
FEATURES = 1 << 15
#: slots of document frequencies, a power of two
SLOTS = 1 << 18
#: words in a larger share of the documents are left out, copies of a passage discounted
COMMON = 0.2
#: least weight of the other words
FLOOR = 0.2
#: groups of following words that are told apart
FOLLOWERS = 8
#: documents whose passages the basis is fitted on (expected number); None: all of them
FIT_DOCS = None
#: item vectors of a block, random directions besides them, and directions kept
BLOCK, SKETCH, RANK = 200, 40, 224
#: content words of half a passage
HALF = 16
#: items of up to so many content words are also sought by their words alone
SHORT = 2 * HALF
#: words in order that such an item needs at least (all, if it has fewer)
FEWEST = 4
#: least cosine of a candidate
COSINE = 0.3
#: share of an item's words in order that settles it, and that which needs the answer too
SURE, LIKELY = 0.6, 0.4
#: share of the answer's words that counts as the answer
ANSWER = 0.8
#: words a worker remembers (twice as many while it forgets)
CACHE_WORDS = 500_000
#: bytes of text that are cut into words together; words of more bytes are numbered one by one
TOGETHER, LONG_WORD = 1 << 21, 48

_SEPARATORS = re.compile(r"[\W_]+")
_EDGES = ".,;:!?\"'()#$%&*|-"
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


class _Words(dict):
    """White-space token -> 32-bit number of its letters and digits in lower case; 0 for none.

    When the table is full, a token stays only if it is met again before the
    table fills once more.
    """

    older: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        number = self.older.get(token)
        if number is None:
            word = token.strip(_EDGES).lower()
            if not word.isalnum():
                word = _SEPARATORS.sub("", word)
            number = (zlib.crc32(word.encode("utf-8", "surrogatepass")) or 1) if word else 0
        if len(token) <= 48:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[token] = number
        return number

    def forget(self) -> None:
        self.older = {}
        self.clear()


_WORDS = _Words()
kept_by_worker(_WORDS.forget)


def word_numbers(text: str) -> np.ndarray:
    numbers = np.fromiter(map(_WORDS.__getitem__, text.split()), np.uint32)
    return numbers[numbers > 0]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
#: byte -> lower-case ASCII letter or digit, 0 for all other bytes
_PLAIN = np.zeros(256, dtype=np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _PLAIN[[_c, ord(chr(_c).upper())]] = _c


def token_numbers(tokens: pa.StringArray) -> np.ndarray:
    """`_WORDS` of every token: ASCII tokens byte by byte, all at once, the others one by one."""
    if not len(tokens):
        return np.zeros(0, np.uint32)
    ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    raw = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    plain = _PLAIN[raw]
    some = plain > 0
    at = np.concatenate([np.zeros(1, np.int32), np.cumsum(some, dtype=np.int32)])[ends]
    plain, begins, lengths = plain[some], at[:-1], np.diff(at)
    alone = np.zeros(len(tokens), dtype=bool)
    alone[np.searchsorted(ends, np.flatnonzero(raw >= 128), "right") - 1] = True
    alone |= lengths > LONG_WORD
    lengths = np.where(alone, 0, lengths).astype(np.uint8)
    order = np.argsort(lengths, kind="stable")[::-1]
    longer = len(tokens) - np.cumsum(np.bincount(lengths, minlength=1))
    begins, crc = begins[order], np.full(len(tokens), 0xFFFFFFFF, dtype=np.uint32)
    for k, n in enumerate(longer[:-1].tolist()):  # the first n tokens have a byte k
        part = crc[:n]
        crc[:n] = _CRC[(part ^ plain[begins[:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    crc = np.maximum(~crc, np.uint32(1))
    crc[longer[0] :] = 0
    out = np.empty_like(crc)
    out[order] = crc
    alone = np.flatnonzero(alone)
    if len(alone):
        out[alone] = list(map(_WORDS.__getitem__, tokens.take(pa.array(alone)).to_pylist()))
    return out


def numbers_of(texts: pa.Array) -> pa.Array:
    """Word numbers of each text, as bytes."""
    if len(texts) > 1 and texts.nbytes > TOGETHER:
        half = len(texts) // 2
        return pa.concat_arrays([numbers_of(texts.slice(0, half)), numbers_of(texts.slice(half))])
    tokens = pc.utf8_split_whitespace(texts.cast(pa.string()).fill_null(""))
    found = tokens.flatten().dictionary_encode()
    numbers = token_numbers(found.dictionary)[found.indices.to_numpy()]
    some = numbers > 0
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())])
    ends = np.concatenate([[0], np.cumsum(some)])[ends] * 4
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(numbers[some])])


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id and the word numbers of every text (as bytes), written once for all passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), numbers_of(batch.column(1))], ["doc_id", "words"])
        _WORDS.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, words binary"), "decontaminate-words")


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all texts one after another, and where each text begins; the end comes last."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    numbers = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.uint32)
    return numbers, (ends - ends[0]).astype(np.int64) // 4


def texts_of(begins: np.ndarray) -> np.ndarray:
    """Number of the text of every word."""
    return np.repeat(np.arange(len(begins) - 1), np.diff(begins))


def inverse_frequencies(words: DataFrame, common: float = COMMON) -> np.ndarray:
    """IDF of every slot over all documents; zero for common words.

    A passage with many copies must not make its words common. In copies a word is
    followed by the same word over and over, a common word by ever others: frequencies
    count only the share of a word's places that its most usual group of followers leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SLOTS, dtype=np.int64), 0
        after = np.zeros(SLOTS * FOLLOWERS, dtype=np.int32)
        for batch in pieces(batches):
            numbers, begins = joined(batch.column(0))
            n += batch.num_rows
            if not len(numbers):
                continue
            slots, text = (numbers & np.uint32(SLOTS - 1)).astype(np.int64), texts_of(begins)
            once = np.sort(text * SLOTS + slots)
            once = once[np.flatnonzero(np.diff(once, prepend=-1))]
            np.add.at(seen, once & (SLOTS - 1), 1)
            follower = (numbers[1:] * np.uint32(2654435769)) >> np.uint32(29)
            same = text[1:] == text[:-1]
            np.add.at(after, (slots[:-1] * FOLLOWERS + follower)[same], 1)
        at = np.flatnonzero(seen)
        after = after.reshape(SLOTS, FOLLOWERS)[at].astype(np.int64)
        # slot -1 carries the number of documents
        columns = [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], n))]
        columns += [pa.array(np.append(after[:, k], 0)) for k in range(FOLLOWERS)]
        yield from pieces([pa.RecordBatch.from_arrays(columns, ["slot", "n", *names])], 8192)

    names = [f"a{k}" for k in range(FOLLOWERS)]
    found = words.select("words").mapInArrow(run, ", ".join(["slot int", "n long", *[f"{a} long" for a in names]]))
    found = found.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(a).alias(a) for a in names])
    places = sum((F.col(a) for a in names[1:]), F.col(names[0]))
    found = gathered(found.select("slot", "n", F.greatest(*names).alias("top"), places.alias("places")))  # SLOTS + 1 rows at most
    at, n, top, places = (found[c].to_numpy() for c in ("slot", "n", "top", "places"))
    total = int(n[at == -1].sum())
    idf = np.full(SLOTS, np.log(1.0 + total), dtype=np.float32)
    some = at >= 0
    at, n = at[some], n[some].astype(np.float64)
    # evenly spread followers leave the whole frequency
    varied = np.minimum(1.0, (1.0 - top[some] / np.maximum(1, places[some])) * FOLLOWERS / (FOLLOWERS - 1))
    n = np.where(places[some] > 0, np.minimum(n, 1.0 + n * varied), n)
    idf[at] = np.maximum(FLOOR, np.log((1.0 + total) / (1.0 + n)))
    idf[at[n > max(2, common * total)]] = 0
    return idf


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, one bit per word of the item."""
    v = full = (1 << length) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def positions(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


class Items:
    """A block of benchmark items: word lists, answers, vectors (one per passage of a long item)."""

    def __init__(self, rows: list[tuple], idf: np.ndarray):
        self.ids, self.words, self.answers, self.content = [], [], [], []
        #: item and first word of every vector
        self.of, self.offset = [], []
        vectors = []
        for item_id, text in rows:
            numbers = word_numbers(text or "")
            if not len(numbers):
                continue
            sentences = [s for s in _SENTENCE.split(text) if len(word_numbers(s))]
            content = idf[numbers & np.uint32(len(idf) - 1)] > 0
            answer = word_numbers(sentences[-1]) if len(sentences) > 1 else numbers
            self.content.append(bool(content.sum() >= 3))
            if self.content[-1]:
                numbers = numbers[content]
                rare = answer[idf[answer & np.uint32(len(idf) - 1)] > 0]
                answer = rare if len(rare) else answer[:0]
            features = numbers & np.uint32(FEATURES - 1)
            weights = idf[numbers & np.uint32(len(idf) - 1)]
            weights = np.where(weights > 0, weights, 1.0)
            firsts = range(0, max(1, len(numbers) - HALF), 2 * HALF)
            for first in firsts:
                part = slice(first, first + 2 * HALF if first < firsts[-1] else None)
                vector = np.zeros(FEATURES, dtype=np.float32)
                np.add.at(vector, features[part], weights[part])
                vectors.append(vector / np.linalg.norm(vector))
                self.of.append(len(self.ids))
                self.offset.append(first)
            self.ids.append(item_id)
            self.words.append(numbers.tolist())
            self.answers.append(answer.tolist())
        self.vectors = np.array(vectors, dtype=np.float32).reshape(len(vectors), FEATURES)


def content_of(numbers: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content words of a text, their features and weights."""
    features = numbers & np.uint32(FEATURES - 1)
    weights = idf[numbers & np.uint32(len(idf) - 1)]
    keep = weights > 0
    return numbers[keep], features[keep], weights[keep]


def passages(count: int) -> np.ndarray:
    """First words of the passages; each has two halves and shares one with the next."""
    return np.arange(0, max(1, count - HALF), HALF)


def halves_of(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each half of a passage begins in joined content words, and whether another half of its text follows."""
    counts = -(-np.diff(begins) // HALF)
    text = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return begins[:-1][text] + number * HALF, np.append(text[1:] == text[:-1], False)[: len(text)]


def sketched(numbers: np.ndarray, begins: np.ndarray, idf: np.ndarray, omega: np.ndarray, out: np.ndarray) -> None:
    """Add `A' A omega` of the texts' passages (rows of A, of length one) to `out`.

    A word counts in the passages that begin and end with its half, so halves are summed once.
    """
    _, features, weights = content_of(numbers, idf)
    begins = np.concatenate([[0], np.cumsum(idf[numbers & np.uint32(len(idf) - 1)] > 0)])[begins]
    first, more = halves_of(begins)
    if not len(first):
        return
    features, lengths = features.astype(np.int64), np.diff(np.append(first, len(features)))
    square = np.add.reduceat(weights.astype(np.float64) ** 2, first)
    # the passage that begins with a half; the last half of a text begins one only where it is the text's only half
    more, begin = more[:-1], more | ~np.append(False, more[:-1])
    square[:-1][more] += square[1:][more]
    scale = np.where(begin, 1.0 / square, 0.0)
    for direction, total in zip(omega.T, out.T, strict=True):  # one at a time, as its features then stay in the cache
        sums = np.add.reduceat(direction[features] * weights, first).astype(np.float64)
        sums[:-1] += sums[1:] * more
        sums *= scale
        sums[1:] += sums[:-1] * more
        total += np.bincount(features, np.repeat(sums, lengths) * weights, minlength=FEATURES)


def sketch(words: DataFrame, idf: np.ndarray, fit_docs: int | None = FIT_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Random directions `omega` and `A' A omega` over the passages of all documents (about `fit_docs` of them, if given)."""
    seed = int(np.random.default_rng(7).integers(1 << 31))
    shared = words.sparkSession.sparkContext.broadcast(idf)
    if fit_docs is not None:
        words = words.filter(sampled(min(1.0, fit_docs / max(1, words.count())), "doc_id"))

    def directions() -> np.ndarray:
        return np.random.default_rng(seed).standard_normal((SKETCH, FEATURES), dtype=np.float32).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, out = directions(), np.zeros((SKETCH, FEATURES)).T
        for batch in pieces(batches):
            numbers, begins = joined(batch.column(0))
            for lo, hi in stretches(begins):
                sketched(numbers[begins[lo] : begins[hi]], begins[lo : hi + 1] - begins[lo], shared.value, omega, out)
        at = np.flatnonzero(np.abs(out).sum(axis=1))
        values = [pa.array(out[at, k].astype(np.float32)) for k in range(SKETCH)]
        yield from pieces([pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *values], ["feature", *names])], 8192)

    names = [f"y{k}" for k in range(SKETCH)]
    rows = words.select("words").mapInArrow(run, ", ".join(["feature int", *[f"{n} float" for n in names]]))
    sums = gathered(rows.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]))  # FEATURES rows at most
    y = np.zeros((FEATURES, SKETCH))
    if sums.num_rows:
        y[sums["feature"].to_numpy()] = np.stack([sums[n].to_numpy() for n in names], axis=1)
    return directions(), y


def stretches(begins: np.ndarray, words: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of texts that have about `words` words together, or a single longer one."""
    lo = 0
    while lo < len(begins) - 1:
        hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + words, "right")) - 1)
        yield lo, hi
        lo = hi


def latent_terms(
    words: DataFrame, idf: np.ndarray, items: Items, fit_docs: int | None = FIT_DOCS, sketch_of: tuple[np.ndarray, np.ndarray] | None = None
) -> np.ndarray:
    """Item scores of every feature, `V (V' B')`: terms in the latent space, dotted with the items there.

    `sketch_of` is what `sketch` returned, for callers with several blocks.
    """
    omega, full = sketch_of or sketch(words, idf, fit_docs)
    y = (full / np.maximum(np.linalg.norm(full, axis=0), 1e-9)).astype(np.float32)
    # an orthonormal basis of both from their small inner products; near-dependent directions are left out
    columns = np.concatenate([items.vectors.T, y], axis=1)
    values, turn = np.linalg.eigh((columns.T @ columns).astype(np.float64))
    strong = values > 1e-5 * values.max()
    basis = columns @ (turn[:, strong] / np.sqrt(values[strong])).astype(np.float32)
    del columns, y
    # inner products of the passages in the basis: A' A is nearly Y (omega' Y)^-1 Y'
    core = omega.T.astype(np.float64) @ full
    values, turn = np.linalg.eigh((core + core.T) / 2)
    strong = values > 1e-9 * max(values.max(), 1e-300)
    seen = (basis.T.astype(np.float64) @ full) @ (turn[:, strong] / np.sqrt(values[strong]))
    inner = seen @ seen.T
    own = items.vectors @ basis
    # the items count as much as all passages together
    inner = inner / max(1e-9, np.trace(inner)) * len(items.vectors) + own.T @ own
    values, turn = np.linalg.eigh(inner)
    rank = max(RANK, len(items.vectors) + RANK - BLOCK)  # a block of one very long item has more vectors
    v = basis @ turn[:, np.argsort(values)[::-1][:rank]].astype(np.float32)
    return v @ (v.T @ items.vectors.T)


def merged(spans: list[tuple], slack: int) -> Iterator[tuple]:
    """Spans (begin, end, cosine, start) that begin within `slack` of each other as one, with the best cosine and its start."""
    spans = sorted(spans)
    at = 0
    while at < len(spans):
        to = at
        while to < len(spans) and spans[to][0] <= spans[at][0] + slack:
            to += 1
        some = spans[at:to]
        yield some[0][0], max(s[1] for s in some), *max(s[2:] for s in some)
        at = to


class Matcher:
    """Finds the items of a block in a text."""

    def __init__(self, idf: np.ndarray, items: Items, terms: np.ndarray):
        self.idf = idf
        self.of, self.offset = items.of, items.offset
        self.plain = [i for i, c in enumerate(items.content) if not c]
        self.items = [(i, positions(w), len(w), positions(a), len(a)) for i, w, a in zip(items.ids, items.words, items.answers, strict=True)]
        self.short = np.array([c and len(w) <= SHORT for c, w in zip(items.content, items.words, strict=True)], dtype=bool)
        pairs = sorted(Counter((w, i) for i, c in enumerate(items.content) if c for w in items.words[i]).items())
        times, pairs = np.array([n for _, n in pairs], dtype=np.int64), [pair for pair, _ in pairs]
        self.keys, begins = np.unique(np.array([w for w, _ in pairs], dtype=np.uint32), return_index=True)
        self.begins = np.append(begins, len(pairs))
        self.holders = np.array([i for _, i in pairs], dtype=np.int64)
        #: the pairs by item, their places in that order, how often the item has the word, and where an item's pairs begin
        order = np.argsort(self.holders, kind="stable")
        self.rank = np.argsort(order)
        self.times = times[order]
        self.held, self.first = np.unique(self.holders[order], return_index=True)
        self.keyed = np.zeros(SLOTS, dtype=bool)
        self.keyed[self.keys & np.uint32(SLOTS - 1)] = True
        lengths = np.array([len(w) for w in items.words], dtype=np.int64)
        #: words of an item that a text needs at least, and those that it needs close together if the item is short
        self.least = np.ceil(LIKELY * lengths - 1e-9).astype(np.int64)
        self.need = np.maximum(self.least, np.minimum(lengths, FEWEST))
        self.columns = np.array(items.of, dtype=np.int64)
        # terms that hardly move any score are not multiplied out
        strong = np.flatnonzero(np.abs(terms).max(axis=1, initial=0.0) >= 0.02) if terms.shape[1] else np.array([], dtype=np.int64)
        self.row = np.full(FEATURES, -1, dtype=np.int32)
        self.row[strong] = np.arange(len(strong))
        self.terms = np.ascontiguousarray(terms[strong], dtype=np.float32)

    def verdict(self, at: int, words: list[int]) -> tuple[float, bool] | None:
        """Share of the item's words in order, and whether the answer is there; None when it is not the item."""
        _, masks, length, answer, answer_length = self.items[at]
        share = lcs(masks, length, words) / length
        if share < LIKELY:
            return None
        found = bool(answer_length) and lcs(answer, answer_length, words) >= ANSWER * answer_length
        return (share, found) if share >= SURE or found else None

    def find(self, every: np.ndarray) -> list[tuple]:
        """(item_id, cosine, share, answer, first content word) of each item found in a text of these words."""
        return [hit for _, hit in self.find_all(every, np.array([0, len(every)]))]

    def find_all(self, words: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, tuple]]:
        """(number of the text, hit) in texts of these words, one after another."""
        for lo, hi in stretches(begins):
            likely = self._likely(words[begins[lo] : begins[hi]], begins[lo : hi + 1] - begins[lo])
            some = np.flatnonzero(likely.any(axis=1)) if not self.plain else range(hi - lo)
            for k in some:
                for hit in self._find(words[begins[lo + k] : begins[lo + k + 1]], likely[k]):
                    yield lo + int(k), hit

    def _likely(self, words: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Whether a text has words enough of an item: a subsequence holds none more often than the text or the item."""
        out = np.zeros((len(begins) - 1, len(self.items)), dtype=bool)
        place, pair = self._places(words)
        if not len(place):
            return out
        text = np.searchsorted(begins, place, "right") - 1
        size = len(self.holders)
        step = max(1, (1 << 20) // size)
        for lo in range(0, len(out), step):
            a, b = np.searchsorted(text, [lo, lo + step])
            rows = min(step, len(out) - lo)
            counts = np.bincount((text[a:b] - lo) * size + self.rank[pair[a:b]], minlength=rows * size).reshape(rows, size)
            counts = np.add.reduceat(np.minimum(counts, self.times), self.first, axis=1)
            out[lo : lo + rows, self.held] = counts >= self.least[self.held]
        return out

    def _find(self, every: np.ndarray, likely_items: np.ndarray) -> list[tuple]:
        best: dict[int, tuple] = {}
        spans: dict[int, list[tuple]] = {}
        numbers, features, weights = content_of(every, self.idf)
        columns = np.flatnonzero(likely_items[self.columns])
        n = len(numbers)
        if n and len(columns):
            rows = self.row[features]
            square = weights.astype(np.float64) ** 2
            energy = np.concatenate([[0.0], np.cumsum(square)])
            useful = np.concatenate([[0.0], np.cumsum(np.where(rows >= 0, square, 0.0))])
            first = passages(n)
            last = np.minimum(first + 2 * HALF, n)
            total, part = energy[last] - energy[first], useful[last] - useful[first]
            # the cosine is at most the root of the useful share
            likely = np.flatnonzero(part >= COSINE * COSINE * total)
            if len(likely):
                cosines = self._cosines(rows, weights, likely, np.sqrt(total[likely]), columns)
                for k, column in zip(*np.nonzero(cosines >= COSINE), strict=True):
                    start, item, before = int(first[likely[k]]), self.of[columns[column]], self.offset[columns[column]]
                    # up to as many words put in as the item has
                    begin, end = start - 2 * before - 2 * HALF, start + 2 * (self.items[item][2] - before) + 4 * HALF
                    spans.setdefault(item, []).append((begin, end, float(cosines[k, column]), start))
            place, pair = self._places(numbers)
            item = self.holders[pair]
            place, item = place[likely_items[item]], item[likely_items[item]]
            order = np.argsort(item, kind="stable")
            place, item = place[order], item[order]
            for short, start in self._by_words(place, item):
                length = self.items[short][2]
                spans.setdefault(short, []).append((start - length - HALF // 2, start + 2 * length + HALF // 2, -1.0, start))
            own, ends = numbers[place].tolist(), np.searchsorted(item, np.arange(len(self.items) + 1)).tolist()
            place = place.tolist()
            for item, found in spans.items():
                length = self.items[item][2]
                for begin, end, cosine, start in merged(found, length // 4 + HALF):
                    # words that are not the item's are in no subsequence of it
                    at, to = (bisect_left(place, p, ends[item], ends[item + 1]) for p in (begin, end))
                    verdict = self.verdict(item, own[at:to]) if to - at >= self.least[item] else None
                    if verdict and cosine < 0:
                        if round(verdict[0] * length) < min(length, FEWEST):
                            continue
                        k = np.array([min(start // HALF, len(first) - 1)])
                        cosine = float(self._cosines(rows, weights, k, np.sqrt(total[k]), np.array([self.of.index(item)]))[0, 0])
                    if verdict and (item not in best or verdict[0] > best[item][1]):
                        best[item] = (cosine, *verdict, start)
        if self.plain:
            words = every.tolist()
            for item in self.plain:  # hardly any words of its own: nearly all its words, close together
                own = self.items[item][2]
                run = lcs(self.items[item][1], own, words) if words else 0
                if run == own and self._in_row(item, words):
                    best[item] = (1.0, 1.0, True, 0)
                elif own >= 6 and run >= ANSWER * own:
                    found = self._nearly_in_row(item, words)
                    if found:
                        best[item] = found
        return [(self.items[i][0], *found) for i, found in sorted(best.items())]

    def _places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place, and number of the pair of word and item, wherever a word of an item stands."""
        at = np.flatnonzero(self.keyed[numbers & np.uint32(SLOTS - 1)]) if len(self.keys) else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        key = np.minimum(np.searchsorted(self.keys, numbers[at]), len(self.keys) - 1)
        own = self.keys[key] == numbers[at]
        at, key = at[own], key[own]
        counts = self.begins[key + 1] - self.begins[key]
        ends = np.cumsum(counts)
        return np.repeat(at, counts), np.arange(counts.sum()) + np.repeat(self.begins[key] - ends + counts, counts)

    def _by_words(self, place: np.ndarray, item: np.ndarray) -> list[tuple[int, int]]:
        """(item, first word) wherever enough words of a short item stand close together, however rare their neighbours."""
        place, item = place[self.short[item]], item[self.short[item]]
        last = np.arange(len(item)) + self.need[item] - 1
        inside = np.flatnonzero(last < len(item))
        item_, last = item[inside], last[inside]
        lengths = np.array([x[2] for x in self.items])[item_]
        close = (item[last] == item_) & (place[last] - place[inside] < 2 * lengths + HALF // 2)
        return list(zip(item_[close].tolist(), place[inside][close].tolist(), strict=True))

    def _cosines(self, rows: np.ndarray, weights: np.ndarray, likely: np.ndarray, norms: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Scores of the passages `likely` with these vectors of items: each half is summed once, then neighbours are added."""
        out = np.zeros((len(likely), len(columns)), dtype=np.float32)
        for lo in range(0, len(likely), 2048):  # a stretch of a long text at a time
            some = likely[lo : lo + 2048]
            first, last = int(some[0]), int(some[-1]) + 2
            at = first * HALF + np.flatnonzero(rows[first * HALF : last * HALF] >= 0)
            halves = np.zeros((last - first, len(columns)), dtype=np.float32)
            for k in range(0, len(at), 16_384):
                part = at[k : k + 16_384]
                half = part // HALF - first
                begins = np.flatnonzero(np.diff(half, prepend=-1))
                halves[half[begins]] += np.add.reduceat(self.terms[rows[part][:, None], columns] * weights[part, None], begins, axis=0)
            out[lo : lo + len(some)] = halves[some - first] + halves[some - first + 1]
        return out / norms[:, None]

    def _nearly_in_row(self, item: int, words: list[int]) -> tuple | None:
        """The best stretch of one and a half times the item's length that has nearly all its words in order and the answer."""
        _, masks, own, answer, answer_length = self.items[item]
        best = None
        for at in range(0, max(1, len(words) - own // 2), max(1, own // 4)):
            part = words[at : at + own + own // 2]
            share = lcs(masks, own, part) / own
            if share >= ANSWER and (best is None or share > best[1]):
                best = (share, share, bool(answer_length) and lcs(answer, answer_length, part) >= ANSWER * answer_length, at)
        return best

    def _in_row(self, item: int, words: list[int]) -> bool:
        masks, own = self.items[item][1], self.items[item][2]
        state, goal = 0, 1 << (own - 1)
        for w in words:  # shift-and search for the whole item
            state = ((state << 1) | 1) & masks.get(w, 0)
            if state & goal:
                return True
        return False


def blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The benchmark, a block of items (of `BLOCK` vectors or one item) at a time."""
    block: list[tuple] = []
    size = 0
    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        vectors = 1 + max(0, len(row["text"].split()) - 3 * HALF) // (2 * HALF)
        if block and size + vectors > BLOCK:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += vectors
    if block:
        yield block


def matchers(words: DataFrame, benchmark: DataFrame, fit_docs: int | None = FIT_DOCS) -> Iterator[Matcher]:
    idf, sketch_of = inverse_frequencies(words), None
    for rows in blocks(benchmark):
        items = Items(rows, idf)
        if items.ids:
            sketch_of = sketch_of or sketch(words, idf, fit_docs)
            yield Matcher(idf, items, latent_terms(words, idf, items, fit_docs, sketch_of))


def contaminated(docs: DataFrame, benchmark: DataFrame, fit_docs: int | None = FIT_DOCS) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, word for every benchmark item found in a document."""
    spark = docs.sparkSession
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, lcs double, answer boolean, word long"
    out = spark.createDataFrame([], schema)
    item_kind = pa.int64() if kinds[1] == "bigint" else pa.int32() if kinds[1] == "int" else pa.string()
    words, shared = numbered(docs), None
    path = f"{shared_folder(spark)}/decontaminate-hits-{uuid.uuid4().hex}"
    for matcher in matchers(words, benchmark, fit_docs):
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                found = list(shared.value.find_all(*joined(batch.column(1))))
                if found:
                    rows = [n for n, _ in found]
                    item, cosine, share, answer, word = zip(*(hit for _, hit in found), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(item, item_kind), pa.array(cosine, pa.float64()), pa.array(share, pa.float64()), pa.array(answer, pa.bool_()), pa.array(word, pa.int64())],
                        ["doc_id", "item_id", "cosine", "lcs", "answer", "word"],
                    )

        write(words.mapInArrow(run, schema), path, "append")
        shared.unpersist()
    return spark.read.schema(schema).parquet(path) if shared else out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, fit_docs: int | None = FIT_DOCS) -> DataFrame:
    """Rows of `docs` in which no benchmark item is found, all columns kept.

    The texts with an item are known by two hashes, gathered block after block.
    """
    spark, names = docs.sparkSession, fresh(docs, "_hash", "_other")
    marks = [F.xxhash64("text").alias(names[0]), F.hash("text").alias(names[1])]
    texts = numbered(docs.select(F.struct(*marks).alias("doc_id"), "text"))
    path, shared = f"{shared_folder(spark)}/decontaminate-found-{uuid.uuid4().hex}", None
    schema = texts.select("doc_id").schema
    for matcher in matchers(texts, benchmark, fit_docs):
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                found = sorted({n for n, _ in shared.value.find_all(*joined(batch.column(1)))})
                yield batch.select([0]).take(pa.array(found, pa.int64()))

        write(texts.mapInArrow(run, schema), path, "append")
        shared.unpersist()
    if not shared:
        return docs
    gone = spark.read.schema(schema).parquet(path).select("doc_id.*").distinct()
    gone = materialise(gone, "decontaminate-gone")
    return docs.select("*", *marks).join(bounded(gone, gone.count(), 56), list(names), "left_anti").select(docs.columns)
