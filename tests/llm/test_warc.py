import hashlib

import pytest
import zstandard

from skein.llm import warc

BIG = "<p>" + "x" * 200 + "</p>"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://e.x/{i}", h, "clash") for i, h in rows], "page_id long, url string, html string, digest string")


def brute(rows):
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        same = [j for j, k in rows if (k or "") == (h or "") and j is not None]
        first = min(same, default=None)
        again = len(raw) >= 100 and first is not None and (i is None or i > first)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_round_trip_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (9, BIG), (5, BIG), (7, BIG), (None, BIG), (11, "ü" * 60), (12, "\r\n\r\n" * 40), (13, "z" * 3_000_000), (14, "WARC/1.1\r\n\r\n"), (5, BIG)]
    back = warc.round_trip(pages(spark, rows), archive_bytes=1 << 20)
    assert got(back) == brute(rows)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in back.collect() if r["record_type"] == "response"}
    assert all(payloads[i] == (h or "") for i, h in rows if i in payloads)
    assert warc.round_trip(pages(spark, rows).filter("page_id < 0")).count() == 0


def test_table_round_trip_gives_the_payloads(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    back = warc.round_trip(table).select("page_id", "url", "payload")
    assert sorted((r[0], r[1], bytes(r[2]).decode()) for r in back.collect()) == sorted((r["page_id"], "".join(r["url"].split()), r["html"]) for r in table.collect())


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    warc.write_archives(pages(spark, [(i, f"page {i} " * 50) for i in range(20)]), path)
    import glob

    files = glob.glob(f"{path}/part-*")
    assert len(files) == 1
    return open(files[0], "rb").read()


def test_archive_is_plain_zstandard(archive):
    assert archive[:4] == bytes.fromhex("5d2a4d18")
    found = list(warc.frames(archive))
    assert len(found) == 20
    raw = found[0][1]
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    assert decoder.decompress(archive[found[0][0] :]) == found[0][2]  # the first frame is one record
    assert found[0][2].startswith(b"WARC/1.1\r\n")


@pytest.mark.parametrize("spoil", [
    lambda a: a[4:], lambda a: a[:-20], lambda a: a[: len(a) // 2], lambda a: a + b"junk", lambda a: b"\0" * 8 + a,
])
def test_damaged_archives_are_refused(archive, spoil):
    with pytest.raises((ValueError, zstandard.ZstdError)):
        for _, _, raw in warc.frames(spoil(archive)):
            warc.parse(raw)


@pytest.mark.parametrize("old,new", [
    (b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Type: response", b"WARC-Type: resp"),
    (b"page 3", b"page 4"), (b"WARC-Date", b"X-Date"), (b"\r\n\r\n", b"\r\n"), (b"HTTP/1.1 200", b"FTP/1.1 200"),
])
def test_damaged_records_are_refused(old, new):
    payload = b"page 3"
    raw = warc.record("response", 3, "http://e.x", payload, hashlib.sha256(payload).hexdigest(), len(payload), None)
    assert warc.parse(raw)[1] == payload
    with pytest.raises(ValueError):
        warc.parse(raw.replace(old, new, 1) if old != b"page 3" else raw.replace(old, new))
