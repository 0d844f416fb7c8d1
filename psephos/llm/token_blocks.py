"""Token-id files in patched frame-of-reference (PFOR) blocks.

A file segment holds whole documents in ascending doc_id order.  Its ids are cut into blocks of
128; each block stores its minimum once, packs the differences at the bit width that a chosen
percentile of them needs, and keeps the upper bits of the outliers in an exception list.  An index
of block starts allows reading any block alone.

Rows of nothing: a null or empty text has no ids but its end id.  Null doc_ids sort first; repeated
rows each keep their own place (ties are ordered by text).  A very long text lies whole in one segment.
Extra columns are ignored.  An empty table gives no segments and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import scratch, slices
from psephos.llm.pieces import library_encoder

MAGIC, BLOCK = b"PFR1", 128
SEGMENT_IDS = 1 << 18
SEGMENT_SCHEMA = "shard int, segment int, before long, n_ids long, first_doc long, doc_ids array<long>, doc_tokens array<long>, blob binary"
_SEGMENT_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("blob", pa.binary())])
_HEAD = struct.Struct("<4sHQI")


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1, 0)


def pfor_encode(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """Pack unsigned 32-bit ids; see the module's text for the format."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return _HEAD.pack(MAGIC, BLOCK, 0, 0)
    full = np.empty(blocks * BLOCK, np.int64)
    full[:n], full[n:] = ids, ids[-1]
    rows = full.reshape(blocks, BLOCK)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = _bit_length(np.partition(rest, at, axis=1)[:, at])
    high = rest >> width[:, None]
    patched = high != 0
    patches = patched.sum(axis=1)
    sizes = width * (BLOCK // 8) + patches * 5
    starts = np.concatenate([[0], np.cumsum(sizes)])
    body = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            bits = np.unpackbits(rest[own].astype("<u4").view(np.uint8).reshape(len(own), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
            body[(starts[own][:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    block, place = np.nonzero(patched)
    if len(block):
        nth = np.arange(len(block)) - (np.cumsum(patches) - patches)[block]
        base = starts[block] + width[block] * (BLOCK // 8)
        body[base + nth] = place
        upper = high[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        body[((base + patches[block] + 4 * nth)[:, None] + np.arange(4)).ravel()] = upper.ravel()
    index = starts[:-1].astype("<u8").tobytes() + low.astype("<u4").tobytes() + width.astype(np.uint8).tobytes() + patches.astype(np.uint8).tobytes()
    return _HEAD.pack(MAGIC, BLOCK, n, blocks) + index + body.tobytes()


class PforReader:
    """Reads a PFOR string whole or block by block through its index."""

    def __init__(self, blob: bytes):
        if len(blob) < _HEAD.size:
            raise ValueError("not a PFOR string: too short")
        magic, size, self.n, self.blocks = _HEAD.unpack_from(blob)
        if magic != MAGIC or size != BLOCK:
            raise ValueError("not a PFOR string: wrong magic or block size")
        at, b = _HEAD.size, self.blocks
        self.starts = np.frombuffer(blob, "<u8", b, at).astype(np.int64)
        self.low = np.frombuffer(blob, "<u4", b, at + 8 * b).astype(np.int64)
        self.width = np.frombuffer(blob, np.uint8, b, at + 12 * b).astype(np.int64)
        self.patches = np.frombuffer(blob, np.uint8, b, at + 13 * b).astype(np.int64)
        self.body = np.frombuffer(blob, np.uint8, offset=at + 14 * b)

    def read(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids of the blocks first to stop."""
        stop = self.blocks if stop is None else stop
        starts, low, width, patches = (x[first:stop] for x in (self.starts, self.low, self.width, self.patches))
        out = np.zeros((stop - first, BLOCK), np.int64)
        for w in np.unique(width):
            if w:
                own = np.flatnonzero(width == w)
                packed = self.body[starts[own][:, None] + np.arange(w * (BLOCK // 8))]
                bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), BLOCK, w)
                wide = np.zeros((len(own), BLOCK, 32), np.uint8)
                wide[:, :, :w] = bits
                out[own] = np.packbits(wide, axis=2, bitorder="little").reshape(len(own), -1).view("<u4")
        block = np.repeat(np.arange(stop - first), patches)
        if len(block):
            nth = np.arange(len(block)) - (np.cumsum(patches) - patches)[block]
            base = starts[block] + width[block] * (BLOCK // 8)
            upper = np.ascontiguousarray(self.body[(base + patches[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
            out[block, self.body[base + nth]] |= upper.astype(np.int64) << width[block]
        ids = (out + low[:, None]).ravel()
        return ids[: self.n - first * BLOCK] if stop == self.blocks else ids


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = library_encoder(path).encode, end_id.to_bytes(4, "little")
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        docs, tokens, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [[shard], [segment], [before], [len(ids)], [docs[0]], [docs], [tokens], [pfor_encode(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _SEGMENT_ARROW, strict=True)], schema=_SEGMENT_ARROW)

        for part in slices(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                docs.append(doc)
                tokens.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
                if held >= SEGMENT_IDS:
                    yield flush()
                    segment, before = segment + 1, before + held
                    docs, tokens, parts, held = [], [], [], 0
        if docs:
            yield flush()

    return run


def write_token_file(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode (doc_id, text) and write the segments under ``out`` in ascending doc_id order.

    One range shuffle orders the documents; Spark's commit protocol makes the files whole even
    if a task is run again.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer, end_id), SEGMENT_SCHEMA).write.option("compression", "none").parquet(out)


_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])


def _documents(with_ids: bool):
    fields = _DOC_ARROW if with_ids else pa.schema(list(_DOC_ARROW)[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=1):
            base, docs, tokens, blob = (c[0].as_py() for c in batch.columns)
            ids = PforReader(blob).read().astype("<u4")
            ends = np.cumsum(tokens)
            starts = ends - tokens
            columns = [docs, starts + base, tokens, [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]]
            if with_ids:
                columns.append([ids[a:b].tolist() for a, b in zip(starts, ends, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return run


def read_token_file(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a token file: doc_id, start (ids before it in the file), n_tokens, ids_crc32 and,
    if asked for, ids.

    The offset of a shard is the sum of the shards before it.  That table has one row for each
    write task, so it is bounded by the number of partitions, not by the rows; a segment adds what
    its shard holds before it.
    """
    from pyspark.sql import Window

    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    placed = segments.join(F.broadcast(before), "shard").select((F.col("shard_start") + F.col("before")).alias("base"), "doc_ids", "doc_tokens", "blob")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return placed.mapInArrow(_documents(with_ids), schema)


def token_file_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    out = scratch(docs.sparkSession, "token-blocks")
    write_token_file(docs, out, tokenizer)
    return read_token_file(docs.sparkSession, out)
