"""Pack documents into windows of tokens by non-negative least squares.

Each document gives full windows and a remainder.  The remainder's core, a multiple of QUANTUM,
belongs to a length class.  All combinations that fill a window exactly and are shallow (at most DEPTH
pieces, or any number of pieces of at most two lengths) are enumerated; NNLS against the class histogram says how often to use each, the counts are rounded
and limited to what is there, and what is left over is packed greedily: cores from long to short
and the short tails behind them, in one run that is cut at window ends.

A task packs its own rows, CHUNK tokens at a time, so nothing is shuffled and memory is bounded; a
chunk hands less than a window to the next one.  The last tokens of a task go to sequences whose
lengths are powers of two, which need no padding.  Sequence ids are unique and ascend within a task:
the partition's number in the upper bits, a count in the lower 33.

A null or empty text is its end id alone; a very long one is cut into full windows.  Repeated rows and
ties are packed each, in the order they come; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from psephos.llm.common import slices
from psephos.llm.pieces import library_encoder

WINDOW, QUANTUM, DEPTH, CHUNK = 2048, 32, 3, 1 << 22


@lru_cache
def combinations(units: int, depth: int) -> np.ndarray:
    """Rows: multiplicities of the classes 1 to units - 1 in each combination that sums to units."""
    found = [(a,) * (units // a) for a in range(1, units) if units % a == 0 and units // a > depth]
    for a in range(1, units):
        for b in range(a + 1, units):
            for n in range(1, (units - a) // b + 1):
                if not (units - n * b) % a and n + (units - n * b) // a > depth:
                    found.append((a,) * ((units - n * b) // a) + (b,) * n)
    for parts in range(2, depth + 1):
        for head in combinations_with_replacement(range(1, units), parts - 1):
            last = units - sum(head)
            if last >= head[-1]:
                found.append((*head, last))
    table = np.zeros((len(found), units - 1))
    for row, combination in enumerate(found):
        for k in combination:
            table[row, k - 1] += 1
    return table


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets."""
    target = a.T @ b
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(100 * (a.shape[0] + a.shape[1])):
        gain = np.where(free, -np.inf, target - a.T @ (a @ x))
        best = int(gain.argmax())
        if gain[best] <= slack:
            break
        free[best] = True
        while True:
            own = np.flatnonzero(free)
            trial = np.zeros_like(x)
            trial[own] = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            low = own[trial[own] <= 0]
            if not len(low):
                x = trial
                break
            step = (x[low] / np.maximum(x[low] - trial[low], 1e-300)).min()
            x = x + max(0.0, step) * (trial - x)
            free &= x > slack * 1e-3
            x[~free] = 0
            if not free.any():
                break
    else:
        raise ArithmeticError("no optimum of the least squares was reached")
    return x


def plan(histogram: np.ndarray, window_units: int, depth: int = DEPTH) -> list[tuple[list[int], int]]:
    """(classes of a combination, how often) within the histogram's counts (index 0: class 1)."""
    table = combinations(window_units, depth)
    left, out = histogram.astype(np.int64).copy(), []
    usable = np.flatnonzero((table <= histogram).all(axis=1))
    if not len(usable):
        return []
    wanted = nnls(table[usable].T, histogram.astype(float))
    for row in np.argsort(-wanted, kind="stable"):
        need = table[usable[row]].astype(np.int64)
        used = need > 0
        times = min(int(np.rint(wanted[row])), int((left[used] // need[used]).min()))
        if times > 0:
            left -= need * times
            out.append(([int(k) + 1 for k in np.flatnonzero(need) for _ in range(need[k])][::-1], times))
    return out


_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int64()))])

#: doc_id, start, ids as bytes (4 for each), tokens of the document
_Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Takes encoded documents one by one; emits rows of finished sequences."""

    def __init__(self, first_sequence: int, window: int = WINDOW, quantum: int = QUANTUM, depth: int = DEPTH, chunk: int = CHUNK):
        if window % quantum:
            raise ValueError("the window must be a multiple of the quantum")
        self.window, self.quantum, self.depth, self.chunk = window, quantum, depth, chunk
        self.sequence, self.rows = first_sequence, []
        self.cores: dict[int, list[_Piece]] = {}
        self.rest: list[_Piece] = []
        self.held = 0

    def emit(self, pieces: list[_Piece]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, at, ids))
            at += len(ids) // 4
        self.sequence += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, wide = len(ids) // 4, self.window * 4
        full = total // self.window
        for i in range(full):
            self.emit([(doc, i * self.window, ids[i * wide : (i + 1) * wide], total)])
        rest = total - full * self.window
        units, tail = divmod(rest, self.quantum)
        if units:
            begin = full * self.window
            self.cores.setdefault(units, []).append((doc, begin, ids[begin * 4 : (begin + units * self.quantum) * 4], total))
        if tail:
            self.rest.append((doc, total - tail, ids[-tail * 4 :], total))
        self.held += rest
        if self.held >= self.chunk:
            self.solve()

    def solve(self) -> None:
        """Pack what is held: planned combinations, then the run of what is left."""
        units = self.window // self.quantum
        histogram = np.array([len(self.cores.get(k, ())) for k in range(1, units)], np.int64)
        for classes, times in plan(histogram, units, self.depth):
            for _ in range(times):
                self.emit([self.cores[k].pop() for k in classes])
        run = [p for k in sorted(self.cores, reverse=True) for p in self.cores[k]] + self.rest
        self.cores = {}
        pieces, filled = [], 0
        for piece in run:
            while filled + len(piece[2]) // 4 >= self.window:
                head, piece = cut(piece, self.window - filled)
                self.emit([*pieces, head])
                pieces, filled = [], 0
                if piece is None:
                    break
            else:
                pieces.append(piece)
                filled += len(piece[2]) // 4
        self.rest, self.held = pieces, filled

    def finish(self) -> None:
        """Pack all; the last tokens go to sequences of falling powers of two."""
        self.solve()
        for bit in range(self.window.bit_length() - 1, -1, -1):
            if self.held >> bit & 1:
                need, pieces = 1 << bit, []
                while need:
                    piece = self.rest.pop(0)
                    if len(piece[2]) // 4 > need:
                        piece, behind = cut(piece, need)
                        self.rest.insert(0, behind)
                    pieces.append(piece)
                    need -= len(piece[2]) // 4
                self.emit(pieces)
        self.held = 0


def cut(piece: _Piece, tokens: int) -> tuple[_Piece, _Piece | None]:
    doc, start, ids, total = piece
    head = (doc, start, ids[: tokens * 4], total)
    return head, (doc, start + tokens, ids[tokens * 4 :], total) if len(ids) > tokens * 4 else None


def _pack(path: str, end_id: int, with_ids: bool, chunk: int):
    fields = _ARROW if with_ids else pa.schema(list(_ARROW)[:-1])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
        if with_ids:
            columns[-1] = [np.frombuffer(b, "<u4").tolist() for b in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=False)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = library_encoder(path).encode, end_id.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 33, chunk=chunk)
        for part in slices(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                packer.add(doc, encode(text) + end)
                if len(packer.rows) >= 2000:
                    yield batch(packer.rows)
                    packer.rows = []
        packer.finish()
        if packer.rows:
            yield batch(packer.rows)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, with_ids: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Pieces of (doc_id, text): where each lies in its document and in its sequence, and if asked for its ids."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_pack(tokenizer, end_id, with_ids, chunk), schema)
