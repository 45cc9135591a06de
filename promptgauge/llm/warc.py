"""WARC archives in Zstandard form: written with a dictionary of their own, read back frame by frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed;
then follows one frame per record, so that any record can be decoded by itself. The reader takes the
dictionary from the leading frame, decodes frame after frame as a stream and checks for each record the version line,
the required headers, that Content-Length is the length of the block and that the block ends the frame, and
for full records that the payload has the length and the SHA-1 the headers state. A damaged archive raises
``ArchiveError``, which names it and the record. ``read_foreign`` reads archives of other writers.

Each writing task makes archives of bounded size in the shared folder and hands on a manifest row for each;
the manifest is written by Spark, and only archives it names are read. What a lost or repeated task left behind
is never read. Archives go through Arrow's file systems, so the shared folder may be any store Arrow knows.

Equal payloads meet as a digest and a length only, in an aggregate with map-side combining: a payload that
a third of all pages share is one row per task. The join back is an equi-join against unique digests.

Defined results: null html is an empty payload, null url an empty target. Of equal payloads (compared by
SHA-256 and length) of at least ``least_bytes`` bytes the largest id is the response and all others are
revisits of it; a null id counts as smaller than any other. Of repeated rows with that id one is the response.
An empty table gives an empty table and no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from promptgauge.session import fresh_path, written

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", VERSION)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
READ_BYTES = 1 << 20
BATCH_BYTES = 2 << 20  # payloads a reading task holds before it hands them on
ROWS_AT_ONCE = 16  # rows of an Arrow batch that are Python objects at once
_MANIFEST = "path string, records long, bytes long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, record_id string, refers_to_record string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _of_urn(urn: str) -> int | None:
    """The id in a name of this writer; others hold none."""
    inner = urn.removeprefix("<urn:page:").removesuffix(">") if urn.startswith("<urn:page:") else ""
    return int(inner) if inner.removeprefix("-").isdecimal() else None


def record(page_id: int | None, url: str | None, payload: bytes, is_revisit: bool, refers_to: int | None) -> bytes:
    """One record. A revisit keeps the HTTP headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from the first records of an archive; empty if there are too few to train on."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # the samples are too short or too much alike
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    held = zstandard.ZstdCompressor(level=3).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held


class _Source:
    """Buffered reading of a stream that can give bytes back."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def read(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.stream.read(max(n - len(self.held), READ_BYTES))):
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out

    def frame(self, contexts) -> bytes | None:
        """The content of the next frame, or None at the end of the archive."""
        first = self.read(4)
        if not first:
            return None
        if first != ZSTD_MAGIC:
            raise ValueError("a record does not begin with a Zstandard frame")
        decoder, out, chunk = contexts.decompressobj(), [], first
        while chunk:
            out.append(decoder.decompress(chunk))
            if decoder.eof:
                self.held = decoder.unused_data + self.held
                return b"".join(out)
            chunk = self.read(READ_BYTES) if not self.held else self.read(len(self.held))
        raise ValueError("the archive ends inside a frame")


class ArchiveError(ValueError):
    """An archive or record that can't be read; names the archive and the number of the record."""


def _checked_digest(stated: str | None, data: bytes, what: str) -> None:
    """Digests are optional, and only SHA-1 in base 32 is checked."""
    algorithm, _, value = (stated or "").partition(":")
    if algorithm.lower() == "sha1" and len(value) == 32 and value.upper() != base32_sha1(data):
        raise ValueError(f"the {what} does not have its digest")


def parsed(raw: bytes) -> dict | None:
    """The checked content of one record; None for kinds that hold no page (warcinfo, request, metadata and others)."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or lines[0].encode() not in VERSIONS:
        raise ValueError(f"not a record of {VERSION.decode()}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"a header without a colon: {name[:80]}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"a record lacks {name}")
    if not headers["content-length"].isdecimal():
        raise ValueError("Content-Length is not a number")
    length = int(headers["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("Content-Length is not the length of the block")
    _checked_digest(headers.get("warc-block-digest"), block, "block")
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    stated = int(lengths[0]) if lengths and lengths[0].isdigit() else None
    held = headers.get("warc-payload-digest")
    if kind == "response":
        if stated is not None and len(payload) != stated:
            raise ValueError("the payload does not have its length and digest")
        _checked_digest(held, payload, "payload")
    elif payload or "warc-refers-to" not in headers:
        raise ValueError("a revisit holds a payload or refers to nothing")
    return {
        "page_id": _of_urn(headers["warc-record-id"]),
        "payload_bytes": len(payload) if kind == "response" else stated,
        "payload_digest": base32_sha1(payload) if kind == "response" else held and held.partition(":")[2].upper(),
        "record_type": kind,
        "refers_to": _of_urn(headers["warc-refers-to"]) if kind == "revisit" else None,
        "url": headers.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
        "record_id": headers["warc-record-id"],
        "refers_to_record": headers.get("warc-refers-to"),
    }


def read_records(stream, name: str = "the archive", own_dictionary: bool = True) -> Iterator[dict]:
    """The pages of one archive. ``own_dictionary``: it must begin with its dictionary; else it may have none, or an uncompressed one."""
    number = 0
    try:
        for raw in _frames(stream, own_dictionary):
            number += 1
            found = parsed(raw)
            if found is not None:
                yield found
    except ValueError as e:
        raise ArchiveError(f"{name}, record {number}: {e}") from e


def _frames(stream, own_dictionary: bool) -> Iterator[bytes]:
    source = _Source(stream)
    start = source.read(8)
    contexts = zstandard.ZstdDecompressor()
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", start[4:])[0]
        held = source.read(size)
        if len(held) != size:
            raise ValueError("the archive ends inside its dictionary")
        if held.startswith(ZSTD_MAGIC):
            held = zstandard.ZstdDecompressor().decompress(held)
        elif own_dictionary:
            raise ValueError("the dictionary is not compressed")
        if held:
            contexts = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    elif own_dictionary:
        raise ValueError("the archive does not begin with its dictionary")
    else:
        source.held = start + source.held
    while (raw := source.frame(contexts)) is not None:
        yield raw


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, is_revisit, refers_to`` for every row."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    key = [F.octet_length("payload").alias("size"), F.unhex(F.sha2("payload", 256)).alias("sha")]
    counted = rows.select("page_id", *key).groupBy("page_id", "size", "sha").agg(F.count("*").alias("n"))
    counted = written(counted, "payloads")
    shared = counted.groupBy("size", "sha").agg(F.max("page_id").alias("first_id"), F.sum("n").alias("of")).filter((F.col("of") > 1) & (F.col("size") >= least_bytes))
    marked = rows.select("*", *key).join(shared, ["size", "sha"], "left")
    is_first = F.col("of").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    marked = marked.select("page_id", "url", "payload", "first_id", "size", "sha", (~is_first).alias("is_revisit"))
    # rows that repeat a first id and its payload: one is the response. Mostly there are none, which a small job tells.
    again = counted.filter("n > 1").join(shared, ["size", "sha"]).filter(F.col("page_id").eqNullSafe(F.col("first_id")))
    again = again.select(F.col("page_id").alias("again_id"), F.col("size").alias("again_size"), F.col("sha").alias("again_sha"))
    if not again.isEmpty():
        hit = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("size") == F.col("again_size")) & (F.col("sha") == F.col("again_sha"))
        one = Window.partitionBy("page_id", "size", "sha").orderBy("url")
        repeated = marked.join(again, hit, "left_semi").withColumn("is_revisit", F.row_number().over(one) > 1)
        marked = marked.join(again, hit, "left_anti").unionByName(repeated)
    return marked.select("page_id", "url", "payload", "is_revisit", F.when(F.col("is_revisit"), F.col("first_id")).alias("refers_to"))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write :func:`decided` rows; the manifest ``path, records, bytes``, written beside the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                    for row in zip(*(c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns), strict=True):
                        yield record(*row)

        source, ended = records(), False
        while not ended:
            first, held = [], 0
            for raw in source:
                first.append(raw)
                held += len(raw)
                if held >= SAMPLE_BYTES:
                    break
            if not first:
                return
            dictionary = trained_dictionary(first)
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
            path, count, size = f"{base}/{uuid.uuid4().hex}.warc.zst", 0, 0
            with store.open_output_stream(path, compression=None) as out:
                size += out.write(leading_frame(dictionary)) or 0
                ended = True
                for raw in first:
                    size += out.write(packer.compress(raw)) or 0
                    count += 1
                for raw in source if size < archive_bytes else ():
                    size += out.write(packer.compress(raw)) or 0
                    count += 1
                    if size >= archive_bytes:
                        break
                ended = size < archive_bytes
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})

    return written(rows.mapInArrow(run, _MANIFEST), "manifest")


def _pages_of(stream, path: str, own: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch | int]:
    """The pages of an archive in batches of bounded size, and their number at the end."""
    count, held, rows = 0, 0, []
    for found in read_records(stream, path, own):
        count, held = count + 1, held + len(found["payload"] or b"")
        rows.append(found)
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            held, rows = 0, []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    yield count


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives a manifest names, checked against its counts."""
    schema = to_arrow_schema(_parse_datatype_string(_RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path, records in zip(batch["path"].to_pylist(), batch["records"].to_pylist(), strict=True):
                with store.open_input_stream(path, compression=None) as stream:
                    for found in _pages_of(stream, path, True, schema):
                        if not isinstance(found, int):
                            yield found
                        elif found != records:
                            raise ArchiveError(f"{path} holds {found} records, its manifest says {records}")

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(run, _RECORD)


def read_foreign(paths: DataFrame) -> DataFrame:
    """The pages of archives by other writers, one task for each address in ``path``.

    Optional headers may be missing, records of other kinds are passed over, a dictionary may be missing or not
    compressed. Record names are kept in ``record_id`` and ``refers_to_record``; ``page_id`` and ``refers_to`` are null
    unless they are names of this writer. ``payload_bytes`` and ``payload_digest`` of a revisit are null where it doesn't state them.
    """
    schema = to_arrow_schema(_parse_datatype_string(_RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, place = _store(path)
                with store.open_input_stream(place, compression=None) as stream:
                    yield from (found for found in _pages_of(stream, path, False, schema) if not isinstance(found, int))

    named = paths.select("path")
    return named.repartition(max(1, named.count()), "path").mapInArrow(run, _RECORD)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: one row per record, payloads included."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(decided(pages, id_col, url_col, html_col, least_bytes), folder), folder)
