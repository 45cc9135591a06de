import base64
import hashlib
import io
import os

import pytest
import zstandard

from promptgauge.llm import warc as op
from promptgauge.session import fresh_path

ROWS = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""), (None, "http://d/", "<p>x</p>"), (5, "http://e/", "é" * 50_000),
        (7, "http://f/", "twice"), (7, "http://f/", "twice"), (6, "http://f/", "twice"), (None, None, "alone"), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (2**61 + 1, "v", "large")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "digest", b"pay") for r in rows], "page_id long, url string, html string, sha string, payload binary")


def brute(rows):
    out, used = [], set()
    for i, _, html in rows:
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        first = max((j for j in same if j is not None), default=None)
        is_first = i == first and (first, html or "") not in used
        if is_first:
            used.add((first, html or ""))
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if is_first else "revisit", None if is_first else first))
    return sorted(map(repr, out))


def test_round_trip(spark):
    found = op.archived(pages(spark)).collect()
    assert sorted(repr(tuple(r)[:5]) for r in found) == brute(ROWS)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in found if r["record_type"] == "response"}
    assert payloads[5] == "é" * 50_000 and payloads[8] == ROWS[10][2]


def test_least_bytes(spark):
    found = {(r["page_id"], r["record_type"]) for r in op.archived(pages(spark), least_bytes=100).collect()}
    assert {kind for _, kind in found} == {"response"}


def test_empty_table(spark):
    assert op.archived(pages(spark, [])).collect() == []


def test_several_archives_with_a_dictionary(spark):
    rows = [(i, f"http://x/{i}", f"<html><head><title>page {i}</title></head><body>" + "common words " * (i % 50 + 5) + "</body></html>") for i in range(3000)]
    folder = fresh_path(spark, "warc-test")
    manifest = op.write_archives(op.decided(pages(spark, rows)).coalesce(1), folder, archive_bytes=20_000)
    assert manifest.count() > 1 and op.read_archives(manifest, folder).count() == 3000
    path = manifest.first()["path"]
    with open(path, "rb") as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18" and int.from_bytes(f.read(4), "little") > 100
    # an archive that no manifest names is not read
    with open(os.path.join(os.path.dirname(path), "left-over.warc.zst"), "wb") as f:
        f.write(b"half written")
    assert op.read_archives(manifest, folder).count() == 3000


def archive(*records):
    return op.leading_frame(b"") + b"".join(zstandard.ZstdCompressor().compress(r) for r in records)


def test_a_frame_per_record_and_damage():
    good = op.record(1, "http://a/", b"payload", False, None)
    assert [r["payload"] for r in op.read_records(io.BytesIO(archive(good, good)))] == [b"payload"] * 2
    bad = {
        "dictionary": zstandard.ZstdCompressor().compress(good),
        "inside a frame": archive(good)[:-3],
        "Content-Length": archive(good.replace(b"payload", b"payloads")),
        "digest": archive(good.replace(b"payload", b"daoylap")),
        "not a record": archive(good.replace(b"WARC/1.1", b"WARC/9.9")),
        "lacks warc-date": archive(good.replace(b"WARC-Date", b"WARC-Dote")),
        "does not begin with a Zstandard frame": archive(good) + b"junk",
    }
    for reason, data in bad.items():
        with pytest.raises(ValueError, match=reason):
            list(op.read_records(io.BytesIO(data)))


def test_dictionary_is_needed():
    samples = [op.record(i, f"http://x/{i}", b"<html>common words and more</html>" * (i % 9 + 1), False, None) for i in range(200)]
    dictionary = op.trained_dictionary(samples)
    assert dictionary
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    data = op.leading_frame(dictionary) + b"".join(map(packer.compress, samples))
    assert [r["page_id"] for r in op.read_records(io.BytesIO(data))] == list(range(200))
    with pytest.raises(zstandard.ZstdError):
        list(op.read_records(io.BytesIO(op.leading_frame(b"") + data[len(op.leading_frame(dictionary)) :])))


def foreign(kind, block, version=b"WARC/1.0", **headers):
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}>", "WARC-Date": "2020-01-01T00:00:00Z", **headers, "Content-Length": len(block)}
    return version + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines.items()) + b"\r\n" + block + b"\r\n\r\n"


def others():
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>y</p>"
    return [
        foreign("warcinfo", b"software: other"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n"),
        foreign("response", page, **{"WARC-Target-URI": "http://a/"}),
        foreign("response", page, version=b"WARC/1.1", **{"WARC-Payload-Digest": "sha1:" + op.base32_sha1(b"<p>y</p>").lower(), "WARC-Block-Digest": "md5:00"}),
        foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", **{"WARC-Refers-To": "<urn:uuid:response>"}),
    ]


def test_archives_of_other_writers(spark, tmp_path):
    records = others()
    raw = zstandard.train_dictionary(4096, [r * 3 + bytes([i]) * 20 for i in range(40) for r in records]).as_bytes()
    plain = b"".join(zstandard.ZstdCompressor().compress(r) for r in records)
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    (tmp_path / "none.warc.zst").write_bytes(plain)
    (tmp_path / "raw.warc.zst").write_bytes((0x184D2A5D).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw + b"".join(map(packer.compress, records)))
    paths = spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "path string")
    found = op.read_foreign(paths).collect()
    assert len(found) == 6 and {r.page_id for r in found} == {None}
    pages_ = [r for r in found if r.record_type == "response"]
    assert {bytes(r.payload) for r in pages_} == {b"<p>y</p>"} and {r.payload_bytes for r in pages_} == {8} and {r.payload_digest for r in pages_} == {op.base32_sha1(b"<p>y</p>")}
    again = [r for r in found if r.record_type == "revisit"]
    assert {(r.payload_bytes, r.payload_digest, r.refers_to, r.refers_to_record) for r in again} == {(None, None, None, "<urn:uuid:response>")}


def test_an_error_names_archive_and_record():
    good, bad = others()[2], others()[3].replace(b"<p>y</p>", b"<p>z</p>")
    data = b"".join(zstandard.ZstdCompressor().compress(r) for r in (good, bad))
    with pytest.raises(op.ArchiveError, match="some.warc, record 2: the payload does not have its digest"):
        list(op.read_records(io.BytesIO(data), "some.warc", own_dictionary=False))


def test_a_long_payload(spark):
    rows = [(1, "u", "long page " * 4_000_000), (2, "u", "short")]
    found = {r.page_id: (r.payload_bytes, r.record_type) for r in op.archived(pages(spark, rows)).select("page_id", "payload_bytes", "record_type").collect()}
    assert found == {1: (40_000_000, "response"), 2: (5, "response")}


def test_a_reading_task_holds_few_payloads(spark):
    """Pages leave the reader in batches of a few MB, however large their archive is."""
    rows = [(i, "u", f"{i:07d}" * 100_000) for i in range(20)]
    folder = fresh_path(spark, "warc")
    (path,) = [r["path"] for r in op.write_archives(op.decided(pages(spark, rows).coalesce(1)).coalesce(1), folder).collect()]
    schema = op.to_arrow_schema(op._parse_datatype_string(op._RECORD))
    with open(path.removeprefix("file:"), "rb") as stream:
        *batches, count = op._pages_of(stream, path, True, schema)
    assert count == len(rows) == sum(b.num_rows for b in batches)
    assert max(b.nbytes for b in batches) < 4 << 20
