"""Personal data by candidate gradient boosting.

Fixed patterns give the base spans (email, ip, card, phone), which always stay.
Wider generators propose more spans, which overlap between kinds but not within one: spelled-out addresses,
numbers without a plus sign, cards with unusual separators, bracketed or
colon-separated host addresses. Every candidate gets format and context
features. Boosted trees learn from the base spans, from the same spans
rewritten the way the generators expect them, and from candidates that fail a
hard check (digit count, check sum, range, a date or decimal, a word that names another
number, a letter or digit next to them). These stay out; the trees then judge
all other candidates, however they are grouped; a threshold per kind, set on
rows kept out of training, selects the redactions.

Training takes about `FIT_CANDIDATES` candidates, as many of every kind and label (or all
there are), chosen by a hash; thresholds are set on all that are held out; every
candidate of every whole text that no hard check settles is judged.

Defined cases: a null text is the empty text, without spans; a null doc_id is
returned as null; repeated rows each get a row; with too few examples of a kind
no span is added to the base ones; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded, pieces, sampled
from skein.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: expected number of training candidates
FIT_CANDIDATES = 20_000
#: trees, their depth, and the precision a threshold must reach on held-out candidates
TREES, DEPTH, PRECISION = 20, 4, 0.98
#: held-out candidates of a class that a threshold needs, and the least threshold
EXAMPLES, LEAST = 20, 0.6

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits, so looking back changes nothing but the cost
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_WIDE = {
    0: re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63})+", re.I),
    1: re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])"),
    2: re.compile(r"(?<![0-9])[0-9](?:[ ./\-]{0,2}[0-9]){12,22}(?![0-9])"),
    3: re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9][0-9 ().\-/]{5,22}[0-9](?![0-9])"),
}
_AT = re.compile(r"@|\(at\)|\[at\]|\{at\}| at ", re.I)
_HOST = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63})+", re.I)
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[-./ ](?:0?[1-9]|1[0-2])[-./ ](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-./ ](?:0?[1-9]|[12][0-9]|3[01])[-./ ](?:19|20)[0-9]{2})(?![0-9])")
#: words before a number that say it is no telephone
_OTHER = re.compile(r"\b(?:order|invoice|build|version|isbn|serial|total|sum|ticket|batch|timestamp)\b\W*(?:no\.?|number|id|is|of)?\W*$", re.I)
#: words before a span that speak for its kind
_CUES = {
    0: re.compile(r"mail|contact|write|reach", re.I),
    1: re.compile(r"\bip\b|host|server|addr", re.I),
    2: re.compile(r"card|visa|credit|payment|account", re.I),
    3: re.compile(r"phone|tel|call|fax|mobile|cell|dial", re.I),
}

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses, found from their @ signs.

    The local part is a run without @, so each @ decides on its own; looking
    from there keeps long runs linear.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield 0, start, domain.end()
            end = domain.end()
        else:
            end = max(end, at)  # what lies before this @ can't be the local part of a later one
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the wide address pattern, found from their at signs, which keeps long runs linear."""
    end, m = 0, _AT.search(text)
    while m:
        stop = m.start() - (m.start() > end and text[m.start() - 1] == " ")
        start = stop
        while start > max(end, stop - 64) and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, m.end()) if start < stop else None
        if host:
            yield start, host.end()
            end = host.end()
        m = _AT.search(text, end if host else m.start() + 1)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, by kind and start; code points, end exclusive."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


FEATURES = 25


def features(kind: int, span: str, left: str, right: str) -> list[float]:
    """Format of a span and what stands around it."""
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    sizes = list(map(len, groups)) or [0]
    tail = re.split(r"[^A-Za-z0-9]+", span)[-1]
    kind_of = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0
    return [
        *(float(kind == k) for k in range(4)),
        float(len(digits)),
        float(sum(c.isalpha() for c in span)),
        float(len(span)),
        float(span.count(" ")),
        float(span.count("-")),
        float(span.count(".")),
        float(span.count("(") + span.count("[")),
        float(span.count("/") + span.count(":")),
        float(len(groups)),
        float(max(sizes)),
        float(min(sizes)),
        float(luhn(digits)) if digits else 0.0,
        float(all(_small(g) for g in groups)),
        len(set(digits)) / max(1, len(digits)),
        float(tail.isalpha()) * len(tail),
        kind_of(left[-1:]),
        kind_of(right[:1]),
        float(bool(_CUES[kind].search(left[-40:]))),
        float(left[-1:] in "([{\"'=:<"),
        float(bool(_OTHER.search(left))),
        float(sum(c.isalpha() for c in left[-10:])),
    ]


def _broken(kind: int, span: str, left: str, right: str) -> bool:
    """True when a candidate certainly isn't of its kind; how a number is grouped says nothing."""
    if left[-1:].isalnum() or right[:1].isalnum():
        return True
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    if kind == 0:
        tail = re.split(r"[^A-Za-z0-9]+", span)[-1]
        # a sentence that ends is no host
        return not (tail.isalpha() and 2 <= len(tail) <= 12) or ". " in span
    if kind == 1:
        return ":" not in span and (not all(map(_small, groups)) or right[:2].strip(".") != right[:2] and right[1:2].isdigit())
    if kind == 2:
        return not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1
    if not 8 <= len(digits) <= 15 or len(set(digits)) < 3 or _DATE.match(span) or re.fullmatch(r"[0-9]+\.[0-9]+", span):
        return True
    return bool(_OTHER.search(left)) and not _CUES[3].search(left[-40:])


def _rewritten(kind: int, span: str) -> list[str]:
    """A base span in forms that only the generators find."""
    if kind == 0:
        return [span.replace("@", " at ").replace(".", " dot "), span.replace("@", " at ")]
    if kind == 1:
        return [span.replace(".", "[.]")]
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 2:
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    return [span.lstrip("+"), digits, f"{digits[:3]} {digits[3:]}", f"{digits[:3]}-{digits[3:]}"]


def candidates(text: str, base: list[Span]) -> list[tuple]:
    """(kind, start, end, label, features); label 1 or 0 to learn from, -1 to judge."""
    out = []

    def around(start: int, end: int) -> tuple[str, str]:
        return text[max(0, start - 48) : start], text[end : end + 8]

    for kind, start, end in base:
        left, right = around(start, end)
        span = text[start:end]
        out.append((kind, start, end, 1, features(kind, span, left, right)))
        out += [(kind, start, end, 1, features(kind, form, left, right)) for form in _rewritten(kind, span)]
    numbers = bool(_DIGIT.search(text))
    taken = sorted((s, e) for _, s, e in base)
    for kind, pattern in _WIDE.items():
        if kind and not numbers:
            continue
        at = 0
        for start, end in (m.span() for m in pattern.finditer(text)) if kind else addresses(text):
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at < len(taken) and taken[at][0] < end:
                continue  # a base span is already here
            left, right = around(start, end)
            span = text[start:end]
            label = 0 if _broken(kind, span, left, right) else -1
            out.append((kind, start, end, label, features(kind, span, left, right)))
    return out


def digest(spans: list[Span]) -> str:
    joined = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
    return hashlib.sha256(joined.encode()).hexdigest()


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("x", pa.list_(pa.float32()))])


def proposed(docs: DataFrame) -> DataFrame:
    """Base spans, their digest, and all candidates of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            base, sha, found = [], [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text or "")
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                sha.append(digest(spans))
                found.append([dict(zip(("kind", "start", "end", "label", "x"), c, strict=True)) for c in candidates(text or "", spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(sha), pa.array(found, pa.list_(_FOUND))],
                ["doc_id", "base", "base_sha256", "found"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "kind:int,start:int,end:int"
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, base array<struct<{span}>>, base_sha256 string, found array<struct<{span},label:int,x:array<float>>>",
    )


def fit(found: DataFrame, fit_candidates: int = FIT_CANDIDATES):
    """Boosted trees and a threshold per kind, or None when there is too little to learn from."""
    known = found.filter("c.label >= 0").withColumn("test", F.pmod(F.xxhash64("row", F.lit("test")), F.lit(4)) == 0)
    # every kind and label gets its own share of the training rows
    share = F.lit(1.0)
    for r in known.filter("NOT test").groupBy("c.kind", "c.label").count().collect():
        own = (F.col("c.kind") == r["kind"]) & (F.col("c.label") == r["label"])
        share = F.when(own, F.lit(min(1.0, fit_candidates / (2 * len(KINDS)) / r["count"]))).otherwise(share)

    def columns(df: DataFrame) -> DataFrame:
        return df.select(F.col("c.kind").alias("kind"), F.col("c.label").cast("double").alias("label"), F.col("c.x").cast("array<double>").alias("x"))

    chosen = columns(known.filter("NOT test").filter(sampled(share, "row", "c")))
    rows = materialise(chosen.coalesce(8), "pii-training").withColumn("features", array_to_vector("x"))
    train = rows.coalesce(4).sortWithinPartitions("x", "label")
    classes = train.agg(F.min("label"), F.max("label")).first()
    if classes[0] != 0.0 or classes[1] != 1.0:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, labelCol="label", cacheNodeIds=False).fit(train)
    judged = model.transform(columns(known.filter("test")).withColumn("features", array_to_vector("x"))).select("kind", "label", (F.floor(vector_to_array("probability")[1] * 100) / 100).alias("p"))
    bins = judged.groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    thresholds = {}
    for kind in range(len(KINDS)):
        own = sorted(((r["p"], r["good"], r["n"]) for r in bins if r["kind"] == kind), reverse=True)
        good = n = 0
        if min(sum(g for _, g, _ in own), sum(m - g for _, g, m in own)) < EXAMPLES:
            continue
        for p, g, m in own:
            good, n = good + g, n + m
            if p >= LEAST and good >= PRECISION * n:
                # in a stretch without held-out candidates every threshold is as precise: its middle
                below = max((q for q, _, _ in own if q < p), default=0.0)
                thresholds[kind] = max(LEAST, (p + below) / 2)
    return (model, thresholds) if thresholds else None


def personal_data(docs: DataFrame, fit_candidates: int = FIT_CANDIDATES) -> DataFrame:
    """doc_id, base counts and digest, and all spans (base, added) of every row."""
    rows = materialise(proposed(docs).withColumn("row", F.monotonically_increasing_id()), "pii-candidates")
    found = rows.select("row", F.explode("found").alias("c"))
    learned = fit(found, fit_candidates)
    open_ones = found.filter("c.label = -1")
    if learned:
        model, thresholds = learned
        least = F.create_map(*[F.lit(x) for k, p in thresholds.items() for x in (k, float(p))])
        judged = model.transform(open_ones.select(
            "row", F.struct("c.kind", "c.start", "c.end").alias("span"), array_to_vector(F.col("c.x").cast("array<double>")).alias("features")
        ))
        good = judged.filter(vector_to_array("probability")[1] >= least[F.col("span.kind")])
    else:
        good = open_ones.select("row", F.struct("c.kind", "c.start", "c.end").alias("span")).filter(F.lit(False))
    # the spans of one text are no more than its length allows
    added = materialise(good.groupBy("row").agg(F.collect_list("span").alias("added")), "pii-added")
    added = bounded(added, added.count(), 512)
    more = F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    every = F.array_sort(F.concat("base", more))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.join(added, "row", "left").select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        "base_sha256",
        F.concat_ws(",", F.transform(every, named)).alias("spans"),
        F.size(more).cast("long").alias("n_added"),
    )
