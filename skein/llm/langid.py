"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter per language, sliced by bit position: slot p of the table holds a
bitmask of the languages whose filter has bit p set. And-ing the slots of an
n-gram gives all languages that contain it in a few reads; every 64 languages
have a table of their own. The hits of each language over a text are counted, corrected for the
filter's share of false positives, and the largest decides.

The filters are built from a bounded share of the rows that may be learned
from (about `FIT_DOCS` per language, chosen by a hash of the id, whole texts);
everything else reads all rows.

Defined cases: a null text, or one without a letter, is `und` with score 0; a
text whose n-grams are in no filter gets the first language by name with score
0; ties go to the first language by name; rows without a language or an id are
never learned from; without any row to learn from all are `und`; repeated rows
each get a row; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import for_learning, forget_tables, held_out, pieces, sampled
from skein.session import materialise

#: expected number of documents per language that filters are built from
FIT_DOCS = 3000
#: an n-gram enters a language's filter when this share of its documents has it
SHARE = 0.02
#: bits of a filter (as a power of two) and bits set per n-gram
LOG_SLOTS, HASHES = 20, 3
#: letters of the n-grams
SIZES = (3, 4)
#: below this corrected share of known n-grams the pipeline rejects a text
LEAST = 0.1

_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64
)
#: code points of a text that are turned into n-grams at a time
_BLOCK = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_blocks(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text: lower case, runs of other characters as one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64)
    blank = np.array([32], dtype=np.uint64)  # the first character kept is a letter
    codes = np.concatenate([blank, codes, blank if codes[-1] != 32 else blank[:0]])
    overlap = max(SIZES) - 1
    for start in range(0, len(codes), _BLOCK):
        part = codes[start : start + _BLOCK + overlap]
        scaled = [part * m for m in _MULTIPLIERS[: max(SIZES)]]
        out = []
        for n in SIZES:
            # the last block has no n-gram that begins after its end
            count = min(len(part) - n + 1, _BLOCK)
            if count > 0:
                h = scaled[0][:count] ^ np.uint64(n)
                for j in range(1, n):
                    h = (h << np.uint64(13)) ^ (h >> np.uint64(51)) ^ scaled[j][j : j + count]
                h = h * _MULTIPLIERS[0]
                out.append(h ^ (h >> np.uint64(29)))
        if out:
            yield np.concatenate(out)


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    """The filter positions of each n-gram."""
    mask = np.uint64((1 << LOG_SLOTS) - 1)
    return [(grams >> np.uint64(k * LOG_SLOTS)) & mask for k in range(HASHES)]


class Filters:
    """The sliced table, its languages, and each filter's share of false positives."""

    def __init__(self, languages: list[str], lang: np.ndarray, grams: np.ndarray):
        self.languages = languages
        self.tables, fill = [], []
        for begin in range(0, len(languages), 64):
            many = min(64, len(languages) - begin)
            kind = next(k for bits, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if many <= bits)
            table = np.zeros(1 << LOG_SLOTS, dtype=kind)
            for n in range(many):
                for at in slots_of(grams[lang == begin + n]):
                    table[at] |= kind(1 << n)
            fill += [np.count_nonzero(table & kind(1 << n)) / len(table) for n in range(many)]
            self.tables.append(table)
        self.false = np.array([f**HASHES for f in fill])

    def decide(self, text: str | None) -> tuple[str, float]:
        hits, total = np.zeros(len(self.languages)), 0
        for grams in gram_blocks(text or ""):
            first, *rest = slots_of(grams)
            total += len(grams)
            for m, table in enumerate(self.tables):
                found = table[first]
                for at in rest:
                    found &= table[at]
                for n in range(min(64, len(self.languages) - 64 * m)):
                    hits[64 * m + n] += np.count_nonzero(found & found.dtype.type(1 << n))
        if not total or not self.languages:
            return "und", 0.0
        share = np.clip((hits / total - self.false) / (1 - self.false), 0.0, 1.0)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, share: float = SHARE) -> Filters:
    """Filters from the rows that may be learned from.

    An n-gram needs `share` of a language's documents, so at most
    (n-grams of a document) / share of them per language reach the driver.
    """
    rows = docs.select("doc_id", "text", "lang").filter(
        for_learning() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Filters([], np.array([], dtype=np.int64), np.array([], dtype=np.uint64))
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, fit_docs / counts[k]))])
    rows = rows.filter(sampled(shares[F.col("lang")], "doc_id"))

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = list(gram_blocks(text))
                if blocks:
                    by.setdefault(lang, []).append(np.unique(np.concatenate(blocks)))
            for lang, grams in by.items():
                gram, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                )

    found = rows.select("lang", "text").mapInArrow(document_counts, "lang string, gram long, n long")
    found = materialise(found.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    used = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for k in languages for x in (k, max(1.0, share * used.get(k, 0)))])
    kept = found.filter(F.col("n") >= least[F.col("lang")]).select("lang", "gram").toArrow()
    lang = np.array([languages.index(k) for k in kept["lang"].to_pylist()], dtype=np.int64)
    return Filters(languages, lang, kept["gram"].to_numpy().view(np.uint64))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2**LOG_SLOTS masks per 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [shared.value.decide(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def identify(docs: DataFrame, **options) -> DataFrame:
    return predict(docs, fit(docs, **options))


def known_language(docs: DataFrame, least: float = LEAST, **options) -> DataFrame:
    """Rows of `docs` whose text is in some learned language, all columns kept.

    The verdict is computed beside the row, so that nothing is joined. The rows are written
    here, as whole texts reach workers 10,000 at a time otherwise, and the filters go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in pieces(batches):
            found = [shared.value.decide(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found]))

    known = materialise(docs.mapInArrow(run, docs.schema), "langid-known")
    shared.unpersist()
    return known
