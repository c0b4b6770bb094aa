"""Packing documents into token sequences by the sum-of-squares rule.

Each task packs the documents of its partition online: a piece goes to the fill level for which the sum of
squared counts of partly filled windows becomes least, and an array holds the count of windows at each
level.  A document's whole windows are cut off first; only what remains is placed.  At the end of a
partition the windows still open are joined by cutting pieces until at most one is left partly
filled, and that one is cut at powers of two, where a sequence needs no padding.  No row leaves its task, so there is
no shuffle, and memory is bounded by the open windows (at most some hundreds of 2048 tokens).

Null or empty texts have the end token alone.  Rows that repeat are packed each.  ``sequence_id`` is
the partition's number times 2**32 plus a count within it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weekloom.llm.pretokens import Memo, byte_letters, default_path, simple, tokenizer, units
from weekloom.llm.textops import ship, small, text_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tokens array<int>"


@lru_cache(2)
def _encoder(path: str):
    load = tokenizer(path)
    packed = lambda text: np.array(load.encode(text, add_special_tokens=False).ids, "<i4").tobytes()
    letters, cut = byte_letters(), load.model.tokenize

    def unit_ids(unit: str) -> bytes:
        written = unit if unit.isascii() else "".join(map(letters.__getitem__, unit.encode()))
        return np.array([x.id for x in cut(written)], "<i4").tobytes()

    memo = Memo(unit_ids, 700_000)
    special = [x.content for x in load.get_added_tokens_decoder().values()]

    def ids(text: str) -> bytes:
        """32-bit little-endian ids."""
        if not simple(text) or any(s in text for s in special):
            return packed(text)
        return b"".join(map(memo.__getitem__, units(text)))

    return ids


class Window:
    __slots__ = ("pieces", "fill")

    def __init__(self):
        self.pieces, self.fill = [], 0

    def add(self, piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece[2])


class SumOfSquares:
    """Open windows by fill level.  A piece is (document, start, ids, tokens of the document)."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[Window]] = defaultdict(list)

    def place(self, piece) -> Window | None:
        """Puts the piece into the best level; gives the window if that filled it."""
        n, count = len(piece[2]), self.count
        # From level h to h + n the sum of squares changes by 2 * (count[h + n] - count[h] + 1);
        # a new window (h = 0) adds 2 * count[n] + 1, and a window that gets full takes away 2 * count[h] - 1.
        cost = 2 * (count[n:] - count[: self.size + 1 - n]) + 2
        cost[0] = 2 * count[n] + 1
        cost[-1] = 1 - 2 * count[self.size - n] if n < self.size else 0
        usable = count[: self.size + 1 - n] > 0
        usable[0] = True
        h = int(np.argmin(np.where(usable, cost, np.iinfo(np.int64).max)))
        window = self.open[h].pop() if h else Window()
        count[h] -= h > 0
        window.add(piece)
        if window.fill == self.size:
            return window
        self.open[window.fill].append(window)
        count[window.fill] += 1
        return None

    def close(self) -> Iterator[Window]:
        """The open windows, emptiest first cut up to fill the fullest; what is left is cut at powers of two."""
        left = [w for level in sorted(self.open) for w in self.open[level]]
        low, high = 0, len(left) - 1
        while low < high:
            to, room = left[high], self.size - left[high].fill
            if room == 0:
                yield to
                high -= 1
                continue
            document, start, ids, tokens = left[low].pieces.pop()
            cut = max(len(ids) - room, 0)
            left[low].fill -= len(ids) - cut
            to.add((document, start + cut, ids[cut:], tokens))
            if cut:
                left[low].pieces.append((document, start, ids[:cut], tokens))
            low += not left[low].fill
        if low == high:
            last = left[low]
            if last.fill == self.size:
                yield last
                return
            rest, power = list(reversed(last.pieces)), self.size
            while rest:
                total = sum(len(p[2]) for p in rest)
                while power > total:
                    power //= 2
                window = Window()
                while window.fill < power:
                    document, start, ids, tokens = rest.pop()
                    take = min(len(ids), power - window.fill)
                    window.add((document, start, ids[:take], tokens))
                    if take < len(ids):
                        rest.append((document, start + take, ids[take:], tokens))
                yield window


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, end: int = 1, tokens: bool = True) -> DataFrame:
    """One row per piece: its document, place there, CRC-32 of its ids as little-endian 32-bit words,
    the document's tokens, its sequence and place in that, and (unless ``tokens`` is false) the ids.  ``size`` is a power of two."""
    path = path or default_path()
    if size & (size - 1):
        raise ValueError("size must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fitter, number = _encoder(path), SumOfSquares(size), TaskContext.get().partitionId() << 32
        rows: list[list] = [[] for _ in range(8)]
        last = np.array([end], "<i4").tobytes()

        def emit(window: Window) -> None:
            nonlocal number
            at = 0
            for document, start, ids, total in window.pieces:
                for column, value in zip(rows, (document, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, at, ids if tokens else None), strict=True):
                    column.append(value)
                at += len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])
            for column in rows:
                column.clear()
            return out

        for batch in small(batches):
            for document, text in zip(batch.column(0).to_pylist(), text_of(batch), strict=True):
                ids = np.frombuffer(encode(text.as_py() or "") + last, "<i4")
                whole = len(ids) - len(ids) % size
                for start in range(0, whole, size):
                    window = Window()
                    window.add((document, start, ids[start : start + size], len(ids)))
                    emit(window)
                if whole < len(ids) and (full := fitter.place((document, whole, ids[whole:], len(ids)))):
                    emit(full)
                if len(rows[0]) > 4000:
                    yield flush()
        for window in fitter.close():
            emit(window)
        yield flush()

    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)
