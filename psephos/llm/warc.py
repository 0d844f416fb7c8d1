"""WARC writing and a salvage reader.

The writer makes gzip archives of one member a record.  Of records with equal payloads of at least
100 bytes the one with the smallest page_id is a response and the others revisit it.

The reader checks each member (gzip checksum), each record (version line, lengths, end marks) and
each payload (digest).  After a failed check it looks for the next valid member or version line,
goes on there, and logs the bytes between as a quarantined gap.  The same is done with the content of a
member, however many records it holds: good ones before and after a bad one are kept, and the gap has
the member's place and says which bytes of the content are lost.  Of a cut member, what could be unpacked
is read likewise; of one that is broken otherwise only records are kept that their own digest proves.

Null html counts as empty, a null url as an empty one.  Repeated rows of the smallest page_id are all
responses; a row without page_id revisits the group's response if there is one.  A very long payload is
one record.  Extra columns are ignored; an empty table gives no archive, no record and no gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import slices, stored

#: Up to so many repeated payloads are sent to every executor (some 100 bytes each); beyond, they are joined.
MOST_BROADCAST_DIGESTS = 200_000
DATE = "2020-01-01T00:00:00Z"
LEAST_REVISIT, ARCHIVE_BYTES = 100, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE, _END = b"\r\n", b"\r\n\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of UUIDs


class Record(NamedTuple):
    offset: int
    size: int
    record_type: str
    page_id: int | None
    url: str
    payload_digest: str
    payload_bytes: int
    refers_to: int | None
    payload: bytes | None


class Gap(NamedTuple):
    offset: int
    size: int
    reason: str


def _clean(value: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def _name(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page}')}>"


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None, is_revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    block = _LINE.join(http) + _END + (b"" if is_revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_name(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([] if page is None else [f"X-Page-ID: {page}"]),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(revisit_of)}", f"X-Refers-To-Page-ID: {revisit_of}"] if is_revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + _END + block + _END) + gz.flush()


class _Bad(ValueError):
    pass


def _headers(data: bytes, at: int) -> tuple[dict[bytes, bytes], int]:
    end = data.find(_END, at)
    if end < 0:
        raise _Bad("no end of the header")
    lines = data[at:end].split(_LINE)
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("malformed header line")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def _int(value: bytes | None) -> int | None:
    number = int(value) if value is not None and re.fullmatch(rb"-?0{0,100}\d{1,19}", value) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """Fields of the record at ``at`` and where the next one starts."""
    if not _VERSION.match(data, at):
        raise _Bad("no version line")
    fields, block_at = _headers(data, at)
    length = _int(fields.get(b"content-length"))
    if length is None or length < 0:
        raise _Bad("no length")
    end = block_at + length
    if data[end : end + 4] != _END:
        raise _Bad("no end mark where the length says")
    block = data[block_at:end]
    digest = fields.get(b"warc-block-digest", b"")
    proven = digest.startswith(b"sha256:")
    if proven and hashlib.sha256(block).hexdigest().encode() != digest[7:]:
        raise _Bad("block digest differs")
    kind = fields.get(b"warc-type", b"").decode("latin-1")
    http, body = ({}, 0) if not block.startswith(b"HTTP/") else _headers(block, 0)
    payload = block[body:] if kind != "revisit" else None
    stated = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
    if payload is not None:
        found = hashlib.sha256(payload).hexdigest()
        if stated and found != stated:
            raise _Bad("payload digest differs")
        proven, stated = proven or bool(stated), found
    size = len(payload) if payload is not None else _int(http.get(b"content-length"))
    return {
        "record_type": kind, "page_id": _int(fields.get(b"x-page-id")), "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
        "payload_digest": stated, "payload_bytes": size if size is not None else 0, "refers_to": _int(fields.get(b"x-refers-to-page-id")), "payload": payload, "proven": proven,
    }, end + 4


class _Member(NamedTuple):
    content: bytes
    end: int
    failure: str


def _member(data: bytes, at: int) -> _Member:
    """The gzip member at ``at``: what can be unpacked, where it ends or unpacking stopped, and why it did."""
    inflate, parts, fed = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof:
            if fed >= len(data):
                return _Member(b"".join(parts), len(data), "cut member")
            parts.append(inflate.decompress(data[fed : fed + 16384]))
            fed += 16384
    except zlib.error:
        # Once more up to the chunk that failed, and through that one byte by byte.
        inflate = zlib.decompressobj(31)
        parts = [inflate.decompress(data[i : i + 16384]) for i in range(at, fed, 16384)]
        try:
            while fed < len(data):
                parts.append(inflate.decompress(data[fed : fed + 1]))
                fed += 1
        except zlib.error:
            pass
        return _Member(b"".join(parts), min(fed + 1, len(data)), "broken member")
    return _Member(b"".join(parts), min(fed, len(data)) - len(inflate.unused_data), "")


_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_START = re.compile(rb"\x1f\x8b\x08|" + _VERSION.pattern)


def _content(content: bytes, proven: bool) -> tuple[list[dict], list[Gap]]:
    """The records of a member's content that pass the checks (``proven``: by a digest of their own), and the gaps between."""
    found, lost, at, bad_from, reason = [], [], 0, -1, ""
    while at < len(content):
        try:
            fields, end = _record(content, at)
            if proven and not fields["proven"]:
                raise _Bad("no digest to prove it")
        except _Bad as e:
            if bad_from < 0:
                bad_from, reason = at, str(e)
            following = _VERSION.search(content, at + 1)
            at = following.start() if following else len(content)
            continue
        if bad_from >= 0:
            lost.append(Gap(bad_from, at - bad_from, reason))
            bad_from = -1
        found.append(fields)
        at = end
    if bad_from >= 0:
        lost.append(Gap(bad_from, len(content) - bad_from, reason))
    return found, lost


def _made(offset: int, size: int, fields: dict) -> Record:
    return Record(offset=offset, size=size, **{k: v for k, v in fields.items() if k != "proven"})


def salvage(data: bytes | None) -> tuple[list[Record], list[Gap]]:
    """All records that pass the checks, and the byte ranges that no such record covers.

    Records of a member have its place; so have gaps inside it.  A member that can't be unpacked to its
    end is a gap as well, with the records that were salvaged from it.
    """
    data = data or b""
    records, gaps, at, bad_from, reason = [], [], 0, -1, ""
    unpacked, unpacked_to = [], 0  # records of a failed member: its raw bytes may show them once more
    while at < len(data):
        failure, following = "", None
        if data.startswith(b"\x1f\x8b\x08", at):
            member = _member(data, at)
            found, lost = _content(member.content, member.failure == "broken member")
            end, failure = member.end, member.failure
            if failure and found:
                # the gap of this member begins here; what was bad before it is one of its own
                if bad_from >= 0 and bad_from < at:
                    gaps.append(Gap(bad_from, at - bad_from, reason))
                    bad_from = -1
                unpacked, unpacked_to = unpacked + found, max(unpacked_to, end)
            if found:
                records += [_made(at, end - at, fields) for fields in found]
            elif not failure:
                failure, following = (lost[0].reason if lost else "empty member"), end
                lost = []
            inside = [Gap(at, end - at, f"{g.reason} (bytes {g.offset} to {g.offset + g.size} of the content)") for g in lost] if found else []
        else:
            inside = []
            try:
                fields, end = _record(data, at)
                if at < unpacked_to and fields in unpacked:
                    unpacked.remove(fields)
                    at = end
                    continue
                records.append(_made(at, end - at, fields))
            except _Bad as e:
                failure = str(e)
        if failure:
            if bad_from < 0:
                bad_from, reason = at, failure
            gaps += inside
            if following is None:
                start = _START.search(data, at + 1)
                following = start.start() if start else len(data)
            at = following
            continue
        if bad_from >= 0:
            gaps.append(Gap(bad_from, at - bad_from, reason))
            bad_from = -1
        gaps += inside
        at = end
    if bad_from >= 0:
        gaps.append(Gap(bad_from, len(data) - bad_from, reason))
    return records, gaps


def plan_revisits(pages: DataFrame) -> DataFrame:
    """pages with digest, payload_bytes, refers_to and is_revisit.

    Smallest ids are found by a partial aggregation over digests alone.  Only payloads of several pages
    are looked up: few of them are broadcast, so no html is shuffled.  Many are joined on the digest, where
    every payload that has no part in this has a key of its own and adaptive execution splits common ones.
    """
    payload = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", "html", F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    first = hashed.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    first = stored(first.select(F.col("digest").alias("key"), "first_id"), "warc-repeated")
    if first.count() <= MOST_BROADCAST_DIGESTS:
        first, key = F.broadcast(first), F.when(F.col("payload_bytes") >= LEAST_REVISIT, F.col("digest"))
    else:
        key = F.when(F.col("payload_bytes") >= LEAST_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("alone "), F.xxhash64("page_id", "url").cast("string")))
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.lit(False))
    return hashed.withColumn("key", key).join(first, "key", "left").select("page_id", "url", "html", "digest", revisit.alias("is_revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"))


_ARCHIVE = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("content", pa.binary())])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part_id, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"part-{part_id:06d}-{number:06d}.warc.gz"]), pa.array([len(parts)], pa.int64()), pa.array([b"".join(parts)], pa.binary())], schema=_ARCHIVE)

    for batch in slices(batches):
        for page, url, html, digest, revisit, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts.append(record_bytes(page, url, (html or "").encode(), digest, first, revisit))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield flush()
                number, parts, size = number + 1, [], 0
    if parts:
        yield flush()


def archives(pages: DataFrame) -> DataFrame:
    """(archive, records, content): archives of about ARCHIVE_BYTES, as a table that any sink takes."""
    return plan_revisits(pages).select("page_id", "url", "html", "digest", "is_revisit", "refers_to").mapInArrow(_write, "archive string, records long, content binary")


_FIELDS = [("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
_GAPS = [("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("reason", pa.string())]


def _rows(fields: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def _read(with_payload: bool, whole: bool):
    fields = _FIELDS if with_payload else _FIELDS[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=1):
            name, content = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            records, gaps = salvage(content)
            if whole and (gaps or len(records) != batch.column(2)[0].as_py()):
                raise ValueError(f"{name}: {len(records)} records read, gaps {gaps[:3]}")
            found = [(name, *r) for r in records]
            for i in range(0, len(found), 256):
                yield _rows(fields, found[i : i + 256])

    return run


def _log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, rows=1):
        name, content = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
        yield _rows(_GAPS, [(name, *g) for g in salvage(content)[1]])


def read_archives(found: DataFrame, with_payload: bool = True, whole: bool = False) -> DataFrame:
    """Records of (archive, content), salvaged; one task an archive, whole archives in memory.

    ``whole`` is for archives of this writer, with their number of records: a gap or a missing one is an error.
    """
    schema = "archive string, offset long, size long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long"
    return found.select("archive", "content", *["records"] * whole).mapInArrow(_read(with_payload, whole), schema + ", payload binary" * with_payload)


def quarantine_log(found: DataFrame) -> DataFrame:
    """Byte gaps of (archive, content) that the salvage reader passed over, with the first failed check."""
    return found.select("archive", "content").mapInArrow(_log, "archive string, offset long, size long, reason string")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, read the archives back: what each record says of its payload.  A gap is an error."""
    back = read_archives(stored(archives(pages), "warc"), with_payload=False, whole=True)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
