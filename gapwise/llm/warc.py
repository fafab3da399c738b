"""WARC archives: written one gzip member per record, read back in byte ranges.

Reading needs no index. A task scans its range for the gzip magic, accepts a place only if
what decodes from there begins as a WARC record header with all it must have, and owns the
records whose member starts inside the range, however far they reach beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapwise.llm.shared import filesystem, keep, scratch
from gapwise.plans.sizing import broadcast_if_small

# Payloads below this size are written in full each time.
REVISIT_BYTES = 1000
# Bytes of a file that one task reads.
SPLIT_BYTES = 8 << 20
# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
_PIECE = 1 << 16

_MANIFEST = "path string, n_records long, n_bytes long"
_RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, "
            "record_type string, refers_to long")


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    record = head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _one_line(value: str) -> str:
    """A header value; control characters, which no address may hold, in percent form."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def page_record(page_id: int, url: str | None, payload: bytes, date: str,
                refers_to: int | None) -> bytes:
    """The gzip member of a page: a response, or a revisit of another page's response."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"),
               ("WARC-Record-ID", f"<{_ID}{page_id}>"), ("WARC-Date", date),
               ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", _one_line(url)))
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             b"Content-Length: %d\r\n\r\n" % len(payload))
    if refers_to is None:
        block += payload
    else:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
    return _member(headers, block)


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    out, n = None, 0
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
            page_id, url, payload, refers_to = (v.as_py() for v in row)
            if out is None:
                path = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
                system, local = filesystem(path)
                system.create_dir(local.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(local, compression=None)
                out.write(_member(
                    [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"),
                     ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
                    b"format: WARC File Format 1.1\r\n"))
            out.write(page_record(page_id, url, payload, date, refers_to))
            n += 1
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({
            "path": [path], "n_records": [n], "n_bytes": [system.get_file_info(local).size]})


_KEY = ["sha1", "n", "h"]


def revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, sha1, n, h, refers_to) of payloads that another page with a larger id also has.

    Only digests and ids are shuffled. Payloads are equal if their SHA-1, length and a
    second hash are.
    """
    facts = keep(pages.filter(F.octet_length("payload") >= least_bytes).select(
        "page_id", *_payload_key()), "payloads")
    key = _KEY
    shared = keep(facts.groupBy(*key).agg(
        F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter(
        "copies > 1").drop("copies"), "copied-payloads")
    return facts.join(shared, key).filter("page_id <> refers_to").select(
        "page_id", *key, "refers_to").distinct()


def _payload_key() -> list:
    return [F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"),
            F.xxhash64("payload").alias("h")]


def write_warc(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z",
               least_bytes: int = REVISIT_BYTES, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page below ``folder`` (default: a new one in the shared folder);
    returns the manifest (path, n_records, n_bytes), one row per file.

    The payload is the html in UTF-8, a null html an empty payload, a null url no target;
    control characters in a url are written in percent form.
    Of equal payloads of at least ``least_bytes`` the one with the largest id is a response
    and the others revisit it; rows that repeat an id are all written. Rows without an id are left
    out, other columns are not read. An empty table gives an empty manifest. Files of lost or
    repeated tasks are in no manifest.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
        F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload")
    ).filter(F.col("page_id").isNotNull())
    again = keep(revisits(rows, least_bytes), "revisits")
    # Rows that repeat an id may have different payloads.
    rows = rows.select("*", *_payload_key()).join(
        broadcast_if_small(again), ["page_id", *_KEY], "left").select(
        "page_id", "url", "payload", "refers_to")
    return keep(rows.mapInArrow(partial(_write, folder=folder, date=date), _MANIFEST),
                "warc-manifest")


class _Bytes:
    """Bytes of a file from a place on, read in pieces as they are asked for."""

    def __init__(self, f, start: int, end: int):
        self.f, self.start, self.size = f, start, f.size()
        self.data = f.read_at(min(end, self.size) - start, start)

    def get(self, at: int, n: int) -> memoryview:
        while at + n > self.start + len(self.data) < self.size:
            more = self.f.read_at(max(_PIECE, at + n - self.start - len(self.data)),
                                  self.start + len(self.data))
            self.data += more
        return memoryview(self.data)[at - self.start:at - self.start + n]


def _inflate(source: _Bytes, at: int) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` holds and where it ends; ``None`` if there is none or
    it does not begin as a WARC header."""
    unpack, parts, seen, place = zlib.decompressobj(31), [], 0, at
    try:
        while not unpack.eof:
            piece = source.get(place, _PIECE)
            if not len(piece):
                return None
            place += len(piece)
            parts.append(unpack.decompress(piece))
            seen += len(parts[-1])
            if len(parts) == 1 and seen >= 8 and not parts[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    record = b"".join(parts)
    if not record.startswith(b"WARC/1."):
        return None
    return record, place - len(unpack.unused_data)


def parse_headers(block: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields by lower-case name, and what follows the blank line."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = block[:end].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, block[end + 4:]


def _record(source: _Bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers and block of the record whose member starts at ``at``, and where it ends."""
    got = _inflate(source, at)
    head = parse_headers(got[0]) if got else None
    if head is None or "warc-type" not in head[0]:
        return None
    size = head[0].get("content-length", "")
    if not size.isdigit() or len(head[1]) < int(size):
        return None
    return head[0], head[1][:int(size)], got[1]


def members(source: _Bytes, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record whose member starts in [start, end).

    Members follow each other without a gap: behind a record, and at the start of a file, a
    place that holds none raises. A range also looks at the member behind its last record,
    which the next range would take for the inside of another one if it is damaged.
    """
    at, follows = start, start == 0
    while at < end:
        if follows:
            got = _record(source, at)
            if got is None:
                raise ValueError(f"no readable record at byte {at}")
        else:
            near = source.get(at, min(_PIECE, end + len(MAGIC) - 1 - at))
            found = near.tobytes().find(MAGIC)
            if found < 0:
                at += max(1, len(near) - len(MAGIC) + 1)
                continue
            at += found
            if at >= end:
                return
            got = _record(source, at)
            if got is None:
                at += 1
                continue
        yield got[0], got[1]
        at, follows = got[2], True
    if follows and at < source.size and _record(source, at) is None:
        raise ValueError(f"no readable record at byte {at}")


def _page_of(value: str) -> int:
    return int(value.strip("<>").removeprefix(_ID))


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = filesystem(row["path"])
            rows = []
            with system.open_input_file(path) as f:
                source = _Bytes(f, row["start"], row["end"])
                for head, block in members(source, row["start"], row["end"]):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, payload = parse_headers(block)
                    digest = base64.b32decode(
                        head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record {head['warc-record-id']} in {path}")
                    to = head.get("warc-refers-to") if kind == "revisit" else None
                    url = head.get("warc-target-uri")
                    rows.append((
                        _page_of(head["warc-record-id"]), url,
                        int(http["content-length"]), digest, kind,
                        None if to is None else _page_of(to),
                        *([payload if kind == "response" else None] if payloads else [])))
                    if len(rows) >= 500:
                        yield _batch(rows, payloads)
                        rows = []
            if rows:
                yield _batch(rows, payloads)


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("record_type", pa.string()),
              ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False
              ) -> DataFrame:
    """Page records of the files of a manifest, read in ranges of ``split_bytes``.

    Columns: page_id, url, payload_bytes, payload_digest (hex SHA-1; both of the full
    payload), record_type, refers_to and, on request, the payload of responses. A member
    that cannot be read, or whose payload does not match its digest, raises.
    """
    n = manifest.agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 1
    ranges = manifest.select("path", "n_bytes", F.explode(F.expr(
        f"sequence(0L, greatest(n_bytes - 1, 0L), {int(split_bytes)}L)")).alias("start"))
    ranges = ranges.select("path", "start", F.least(
        F.col("start") + split_bytes, F.col("n_bytes")).alias("end"))
    return ranges.repartition(int(n)).mapInArrow(
        partial(_read, payloads=payloads), _RECORDS + (", payload binary" if payloads else ""))
