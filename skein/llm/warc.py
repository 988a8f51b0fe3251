"""WARC archives in Zstandard: one frame per record, a dictionary up front.

An archive begins with a skippable frame that holds the dictionary; then every
record is a frame of its own, and an empty skippable frame follows each as a
separator. The files are written by Spark's text writer, whose line end is that
separator, so any file system that Spark knows works and failed tasks leave
nothing behind. The reader loads the dictionary from the leading frame, decodes
one frame per record, and checks version, headers, lengths and digests; a
record that fails stops the job with its archive and place.

Of records with equal payloads of at least `REVISIT_BYTES` the one with the smallest
id is the response, the others are revisits of it without payload.

Defined cases: a null payload is the empty payload, a null url the empty url; a
null page_id is written without an id, may be a response and is never one's
revisit target unless all ids of its payload are null; repeated rows with the
smallest id of their payload are all responses; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded, sampled
from skein.session import materialise, shared_folder

#: equal payloads from this length on become revisits
REVISIT_BYTES = 100
#: payload bytes of an archive
ARCHIVE_BYTES = 32 << 20
#: expected pages and largest size of the dictionary's training sample and of the dictionary
FIT_PAGES, FIT_BYTES, DICTIONARY_BYTES = 400, 8 << 20, 64 << 10
LEVEL = 6

# fixed values of the format: frame magics (little-endian) and the separator frame
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
SEPARATOR = struct.pack("<II", SKIPPABLE, 0)


def train(samples: list[bytes]) -> bytes:
    """A dictionary, or the samples' own bytes where there are too few to train on."""
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def leading_frame(dictionary: bytes) -> bytes:
    """Skippable frame with the compressed dictionary."""
    packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(dictionary)
    return struct.pack("<II", DICTIONARY, len(packed)) + packed


def record(kind: str, page_id, url: str, payload: bytes, digest: str, length: int, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + payload
    header = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(url.split())),
        ("WARC-Page-ID", "" if page_id is None else page_id),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", refers_to)] if kind == "revisit" else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in header)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def frames(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, dictionary, record) of every record frame."""
    if not data:
        return
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY:
        raise ValueError("no leading dictionary frame")
    size = struct.unpack_from("<I", data, 4)[0]
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]) if size else b""
    options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    decoder, at = zstandard.ZstdDecompressor(**options), 8 + size
    view = memoryview(data)
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError(f"cut off at {at}")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if at + 8 > len(data):
                raise ValueError(f"cut off at {at}")
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                raise ValueError(f"cut off at {at}")
        elif magic == FRAME:
            one = decoder.decompressobj()
            size = zstandard.get_frame_parameters(view[at : at + 32]).content_size
            out, end = [], at
            while not one.eof and end < len(data):  # a piece at a time: the frame's end isn't known
                out.append(one.decompress(view[end : end + 65536]))
                end += 65536
            if not one.eof:
                raise ValueError(f"cut off at {at}")
            text = b"".join(out)
            if size not in (zstandard.CONTENTSIZE_UNKNOWN, len(text)):
                raise ValueError(f"length of the frame at {at}")
            yield at, raw, text
            at = min(end, len(data)) - len(one.unused_data)
        else:
            raise ValueError(f"no frame at {at}")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.decode("utf-8").partition("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("version line")
    headers = {}
    for line in lines.split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"header line {line!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise ValueError(f"no {name}")
    length = int(headers["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("record length")
    if headers.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("payload header")
    stated = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if stated is None:
        raise ValueError("payload length")
    headers["payload-length"] = str(stated)
    kind = headers["warc-type"]
    if kind == "response":
        if stated != len(payload) or headers.get("warc-payload-digest") != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise ValueError("payload digest or length")
    elif kind == "revisit":
        if payload or "warc-refers-to-page-id" not in headers:
            raise ValueError("revisit")
    else:
        raise ValueError(f"type {kind}")
    return headers, payload


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of `pages` (page_id, url, html) to archives under `path`."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("length"),
    )
    # one narrow row per payload and task travels; copies are counted where they lie
    first = rows.filter(F.col("length") >= REVISIT_BYTES).groupBy(F.col("digest").alias("same")).agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    first = materialise(first.filter("n > 1").select("same", "first"), "warc-first")
    totals = rows.agg(F.count(F.lit(1)), F.sum("length")).first()
    sample = rows.filter((F.col("length") > 0) & sampled(min(1.0, FIT_PAGES / max(1, totals[0])), "page_id", "digest"))
    # cut to a share of the training bytes each; about FIT_PAGES rows reach the driver
    sample = sample.select("digest", F.substring("payload", 1, FIT_BYTES // FIT_PAGES).alias("part")).orderBy("digest")
    dictionary = train([bytes(r["part"]) for r in sample.collect()])
    front = leading_frame(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        encoder = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **options)
        begun = False
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                out = [] if begun else [front]
                for r in batch.slice(start, 128).to_pylist():
                    again = r["revisit"]
                    raw = record("revisit" if again else "response", r["page_id"], r["url"], b"" if again else r["payload"], r["digest"], r["length"], r["first"])
                    out.append(encoder.compress(raw))
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    marked = rows.join(bounded(first, first.count(), 80), F.col("digest") == F.col("same"), "left")
    again = (F.col("length") >= REVISIT_BYTES) & F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    marked = marked.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", "length", again.alias("revisit"), "first")
    archives = max(1, -(-(totals[1] or 0) // archive_bytes))
    marked.repartition(archives).mapInArrow(run, "frame binary").select(F.col("frame").cast("string")).write.option(
        "lineSep", SEPARATOR.decode("latin-1")
    ).text(path)


def read_archives(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to of every record under `path`."""

    number = {"bigint": int, "long": int, "int": int}.get(kind, str)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        ids = pa.int64() if number is int and kind != "int" else pa.int32() if number is int else pa.string()
        kinds = [ids, pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), ids]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                name, rows = batch.column(0)[k].as_py(), []
                for at, _, raw in frames(batch.column(1)[k].as_py()):
                    try:
                        h, payload = parse(raw)
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                    except (ValueError, KeyError) as fault:
                        raise ValueError(f"{name}, frame at {at}: {fault}") from fault
                    own, target = h.get("warc-page-id", ""), h.get("warc-refers-to-page-id", "")
                    rows.append((number(own) if own else None, h.get("warc-target-uri", ""), h["warc-type"], payload, int(h["payload-length"]), digest, number(target) if target else None))
                    if len(rows) == 256:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(
        run, f"page_id {kind}, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to {kind}"
    )


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write `pages` to archives in the shared folder and read all records back."""
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, archive_bytes)
    return read_archives(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString())
