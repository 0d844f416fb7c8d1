"""Matroska as a media column: mux samples, and parse EBML into packet tables.

The parser walks variable-length elements (also of unknown size), clusters, SimpleBlocks and
BlockGroups, undoes all three lacings, and gives every frame its track, timestamp and byte range,
besides the cue points.  What is cut off or malformed ends the walk; what stood before is kept and
``error`` says where it ended.

A block of a BlockGroup is a key frame unless it has a ReferenceBlock.  Laces follow in time by their
track's DefaultDuration, else by the group's BlockDuration in equal parts, else by the samples in 8-bit
mono PCM; without any of these all have the block's time.

``mux_payload`` stores bytes as 8-bit mono PCM.  Equal payloads make equal files: nothing in a file
depends on time, place or id.  Null text counts as empty; a very long one makes many clusters.  Repeated
rows and ties are stored each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from psephos.llm.common import slices, stored

# Element ids of the Matroska specification.
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
REFERENCE_BLOCK, BLOCK_DURATION, DEFAULT_DURATION = 0xFB, 0x9B, 0x23E383
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, TRACKS, TRACK_ENTRY, AUDIO, INFO}
TOP_LEVEL = {CLUSTER, CUES, TRACKS, INFO}
XIPH, FIXED, EBML_LACE = 1, 2, 3

RATE, FRAME, LACED, BLOCKS = 8000, 256, 8, 16  # samples a second, samples a frame, frames a block, blocks a cluster


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    cluster: int
    block: int
    lace: int
    keyframe: bool
    offset: int
    size: int


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, byte offset of the cluster in the segment
    clusters: int
    blocks: int
    tracks: list[tuple[int, int, str]]  # number, type, codec
    error: str | None


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _element(tag: int, data: bytes) -> bytes:
    return tag.to_bytes((tag.bit_length() + 7) // 8, "big") + _size(len(data)) + data


def _uint(tag: int, n: int) -> bytes:
    return _element(tag, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag and body: fixed where all sizes are equal, EBML (signed differences) else."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return FIXED, bytes([len(frames) - 1]) + b"".join(frames)
    head = bytes([len(frames) - 1]) + _size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << (7 * w - 1)) - 1)
        head += ((b - a) + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")
    return EBML_LACE, head + b"".join(frames)


_HEAD = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ, 2))
_INFO = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"psephos") + _element(WRITING_APP, b"psephos"))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def mux_payload(payload: bytes) -> bytes:
    """One track of 8-bit samples: laced blocks in clusters, and a cue for each cluster."""
    body, cues, at = [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    span = FRAME * LACED
    for start in range(0, len(payload), span * BLOCKS):
        time = start * 1000 // RATE
        blocks = [_uint(TIMESTAMP, time)]
        for a in range(start, min(start + span * BLOCKS, len(payload)), span):
            chunk = payload[a : a + span]
            flag, data = _laced([chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)])
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", a * 1000 // RATE - time, 0x80 | flag << 1) + data))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, time) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(body))


class _Cut(ValueError):
    pass


def _vint(data: bytes, at: int, end: int, keep: bool) -> tuple[int, int]:
    """Value and next place of a variable-length integer; an id keeps its marker; -1: unknown size."""
    if at >= end or not data[at]:
        raise _Cut(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end or keep and width > 4:
        raise _Cut(f"cut integer at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep:
        return value, at + width
    value &= (1 << (7 * width)) - 1
    return -1 if value == (1 << (7 * width)) - 1 else value, at + width


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise _Cut(f"cut lacing at {at}")
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == FIXED:
        if (end - at) % count:
            raise _Cut(f"uneven fixed lacing at {at}")
        sizes = [(end - at) // count] * count
    elif lacing == XIPH:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise _Cut(f"cut lacing at {at}")
                size, at, more = size + data[at], at + 1, data[at] == 255
                if not more:
                    break
            sizes.append(size)
    else:
        for i in range(count - 1):
            before = at
            value, at = _vint(data, at, end, False)
            if i:
                width = at - before
                raw = int.from_bytes(data[before:at], "big") & ((1 << (7 * width)) - 1)
                value = sizes[-1] + raw - ((1 << (7 * width - 1)) - 1)
            if value < 0:
                raise _Cut(f"negative lace size at {before}")
            sizes.append(value)
    if lacing != FIXED:
        sizes.append(end - at - sum(sizes))
    if sizes[-1] < 0:
        raise _Cut(f"laces run over the block at {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes | None) -> Media:
    """Packets, cues and tracks of a file."""
    data = data or b""
    packets, cues, tracks = [], [], []
    state = {"scale": 1_000_000, "time": 0, "cluster": -1, "block": 0, "segment": 0, "cue": [0, 0, 0], "track": [0, 0, "", 0.0, 0, 0, 1], "group": [0, False, 0]}

    def block(at: int, end: int, simple: bool) -> None:
        begin = at
        track, at = _vint(data, at, end, False)
        if at + 3 > end:
            raise _Cut(f"cut block at {begin}")
        relative, flags = struct.unpack_from(">hB", data, at)
        laces = _frames(data, at + 3, end, flags >> 1 & 3)
        start = (state["time"] + relative) * state["scale"]
        _, kind, codec, rate, every, depth, channels = next((t for t in tracks if t[0] == track), (track, 0, "", 0.0, 0, 0, 1))
        if not (kind == 2 and codec.startswith("A_PCM/INT") and depth == 8 and channels == 1):
            rate = 0  # only there is a byte a sample
        for i, (offset, size) in enumerate(laces):
            time = start + (i * every if every else (offset - laces[0][0]) * 1_000_000_000 // int(rate) if rate else 0)
            packets.append(Packet(track, time, state["cluster"], state["block"], i, bool(flags & 0x80) if simple else True, offset, size))
        state["block"] += 1

    def grouped() -> None:
        """What the elements around a block, in any order, say of its frames."""
        first, refers, duration = state["group"]
        laces = packets[first:]
        timed = any(p.timestamp_ns != laces[0].timestamp_ns for p in laces)
        for i, p in enumerate(laces):
            time = p.timestamp_ns + (0 if timed else i * duration * state["scale"] // len(laces))
            packets[first + i] = p._replace(keyframe=not refers, timestamp_ns=time)

    def walk(at: int, end: int, parent: int) -> int:
        while at < end:
            start = at
            tag, at = _vint(data, at, end, True)
            if parent == CLUSTER and tag in TOP_LEVEL:
                return start  # ends a cluster of unknown size
            size, at = _vint(data, at, end, False)
            stop = end if size < 0 else at + size
            cut = stop > end
            stop = min(stop, end)
            if tag in MASTERS:
                if tag == SEGMENT:
                    state["segment"] = at
                elif tag == CLUSTER:
                    state["cluster"] += 1
                elif tag == CUE_POINT:
                    state["cue"] = [0, 0, 0]
                elif tag == TRACK_ENTRY:
                    state["track"] = [0, 0, "", 0.0, 0, 0, 1]
                elif tag == BLOCK_GROUP:
                    state["group"] = [len(packets), False, 0]
                at = walk(at, stop, tag)
                if tag == BLOCK_GROUP:
                    grouped()
                if tag == CUE_POINT:
                    cues.append(tuple(state["cue"]))
                elif tag == TRACK_ENTRY:
                    tracks.append(tuple(state["track"]))
            else:
                if cut:
                    raise _Cut(f"element at {start} is cut")
                number = lambda: int.from_bytes(data[at:stop], "big")  # noqa: B023, E731
                if tag == SIMPLE_BLOCK or tag == BLOCK:
                    block(at, stop, tag == SIMPLE_BLOCK)
                elif tag == TIMESTAMP:
                    state["time"] = number()
                elif tag == TIMESTAMP_SCALE:
                    state["scale"] = number()
                elif tag == TRACK_NUMBER:
                    state["track"][0] = number()
                elif tag == TRACK_TYPE:
                    state["track"][1] = number()
                elif tag == CODEC_ID:
                    state["track"][2] = data[at:stop].decode("latin-1").rstrip("\0")
                elif tag == SAMPLING:
                    state["track"][3] = struct.unpack(">d" if stop - at == 8 else ">f", data[at:stop])[0] if stop - at in (4, 8) else 0.0
                elif tag == DEFAULT_DURATION:
                    state["track"][4] = number()
                elif tag == BIT_DEPTH:
                    state["track"][5] = number()
                elif tag == CHANNELS:
                    state["track"][6] = number()
                elif tag == REFERENCE_BLOCK:
                    state["group"][1] = True
                elif tag == BLOCK_DURATION:
                    state["group"][2] = number()
                elif tag == CUE_TIME:
                    state["cue"][0] = number()
                elif tag == CUE_TRACK:
                    state["cue"][1] = number()
                elif tag == CUE_CLUSTER:
                    state["cue"][2] = number()
                at = stop
            if cut:
                raise _Cut(f"element at {start} is cut")
        return at

    error = None
    try:
        walk(0, len(data), 0)
    except (_Cut, struct.error) as e:
        error = str(e)
    return Media(packets, cues, state["cluster"] + 1, state["block"], [t[:3] for t in tracks], error)


def text_payload(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def features(media: Media, samples: bytes) -> str:
    """A summary of the packet table and of the samples, in integers only."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    last = media.packets[-1] if media.packets else None
    total = last.timestamp_ns // 1_000_000 + last.size * 1000 // RATE if last else 0
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128))) if len(x) else 0
    return (
        f"clusters={media.clusters};blocks={media.blocks};packets={len(media.packets)};cues={len(media.cues)};ms={total};"
        f"sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};largest={max((p.size for p in media.packets), default=0)}"
    )


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = part.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [part.column(0).cast(pa.int64()), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([mux_payload(text_payload(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"]
        )


def mux_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a media column that holds the text as 8-bit samples."""
    return docs.select("doc_id", "text").mapInArrow(_mux, "doc_id long, n_bytes long, media binary")


_PACKETS = pa.schema([("doc_id", pa.int64())] + [(n, pa.bool_() if n == "keyframe" else pa.int64()) for n in Packet._fields])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, rows=64):
        rows = [(doc, *p) for doc, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for p in parse(m).packets]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PACKETS)], schema=_PACKETS)


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each frame of (doc_id, media): track, timestamp, place in the file; no shuffle."""
    schema = ", ".join(f"{f.name} {'boolean' if f.name == 'keyframe' else 'long'}" for f in _PACKETS)
    return media.select("doc_id", "media").mapInArrow(_explode, schema)


_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = []
        for doc, n, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
            media = parse(data)
            if media.error:
                raise ValueError(f"stored media of document {doc}: {media.error}")
            payload = b"".join([data[p.offset : p.offset + p.size] for p in media.packets])
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(media, payload)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_READ)], schema=_READ)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as a media column, read the stored bytes back and describe them."""
    media = stored(mux_documents(docs), "media")
    return media.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
