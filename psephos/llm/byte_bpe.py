"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has exactly one valid last token: the token that ends there, stands
for itself under the merges, and may follow the last token of what stands before it.  Storing these
last tokens lets a string grow (or change near its end) without encoding its beginning again.

A null or empty text has no ids; a very long one is encoded whole, match by match.  Repeated rows and ties
are encoded each; extra columns are ignored; an empty table gives no rows.  A vocabulary lists byte strings with ranks; ranks are the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from psephos.llm.common import slices
from psephos.llm.pieces import PieceEncoder

MAX_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixBpe:
    """The tables of one vocabulary: which tokens stand for themselves, which may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._alone: dict[int, bool] = {}
        self._follows: dict[tuple[int, int], bool] = {}

    def merges(self, data: bytes) -> list[bytes]:
        """The plain definition of BPE, for tokens and pairs of tokens: merge the lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def alone(self, token: int) -> bool:
        """Whether the merges make this token from its own bytes."""
        if token not in self._alone:
            self._alone[token] = len(self.merges(self.bytes_of[token])) == 1
        return self._alone[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens' bytes give these two tokens again."""
        known = self._follows.get((left, right))
        if known is None:
            if len(self._follows) >= MAX_PAIRS:
                self._follows.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self._follows[left, right] = self.merges(a + b) == [a, b]
        return known


class PrefixTable:
    """Last tokens of all prefixes of one byte string."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact append: only the new prefixes are looked at."""
        start = len(self.data)
        self.data += more
        bpe, data, last = self.bpe, self.data, self.last
        rank, longest = bpe.ranks.get, bpe.longest
        for end in range(start + 1, len(data) + 1):
            for begin in range(max(0, end - longest), end):
                token = rank(data[begin:end])
                if token is not None and bpe.alone(token) and (not begin or (last[begin] >= 0 and bpe.follows(last[begin], token))):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace data[start:stop]; returns how many prefixes were looked at anew.

        Once as many last tokens as the longest token has bytes are as before (moved), all later
        ones are too, and are kept.
        """
        tail, old, shift = self.data[stop:], self.last, len(new) - (stop - start)
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new)
        same = done = 0
        for i in range(len(tail)):
            if same >= self.bpe.longest:
                self.data += tail[i:]
                self.last += old[stop + i + 1 :]
                break
            self.append(tail[i : i + 1])
            done += 1
            same = same + 1 if self.last[-1] == old[len(self.data) - shift] else 0
        return len(new) + done

    def tokens(self, end: int | None = None) -> list[int]:
        """Ids of the prefix up to ``end``, read back from its last token."""
        end, out = len(self.data) if end is None else end, []
        while end:
            out.append(self.last[end])
            end -= len(self.bpe.bytes_of[out[-1]])
        return out[::-1]


_OPEN: dict[str, tuple[PrefixBpe, PieceEncoder, dict[int, str]]] = {}


def codec(path: str) -> tuple[PrefixBpe, PieceEncoder, dict[int, str]]:
    """The vocabulary, a text encoder and decimal ids; one of each for a worker process."""
    if path not in _OPEN:
        bpe = PrefixBpe(read_ranks(path))

        def piece(text: str) -> bytes:
            data = text.encode()
            known = bpe.ranks.get(data)  # a piece that is a token is that token, whatever the merges
            return np.asarray([known] if known is not None else PrefixTable(bpe, data).tokens(), "<u4").tobytes()

        _OPEN[path] = bpe, PieceEncoder(piece), {rank: str(rank) for rank in bpe.bytes_of}
    return _OPEN[path]


def encode(text: str | None, path: str) -> list[int]:
    return np.frombuffer(codec(path)[1].encode(text), "<u4").tolist()


def decode(ids: list[int], path: str) -> bytes:
    return b"".join(map(codec(path)[0].bytes_of.__getitem__, ids))


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder, decimal = codec(path)
        for part in slices(batches):
            n, sha, back = [], [], []
            for text in part.column(1).to_pylist():
                ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(bpe.bytes_of.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], schema=_ARROW)

    return run


def _ids(path: str):
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([encode(t, path) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], schema=fields)

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every text; no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_ids(path), "doc_id long, ids array<long>")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them; no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
