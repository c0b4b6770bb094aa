"""Phrases whose words stand together more often than chance has it, by weighted acyclic automata of n-grams.

Everything is counted by language, in *blocks* of bounded size, and texts are read three times:

1.  Words are counted and added up over all blocks.  A phrase with a word found less than ``least`` times can't be found ``least`` times
    either, so a bitmap of the hashes of the frequent words is broadcast.
2.  Pairs of neighbouring frequent words are counted by 32 bits of their hash, and a second bitmap is made of those that may be frequent.
3.  A block's n-grams of 2 to ``longest`` words, cut where a word or pair isn't in the bitmaps, are sorted and made into *count transducers*, one for
    each range of prefixes: acyclic automata in which an arc's weight is the count of the n-gram that it ends.  They are built incrementally from sorted
    batches: what lies below a prefix of two words is finished with its batch, and states with the same arcs and weights are kept once, by a register.
    A range's transducers are united and their weights summed; n-grams found ``least`` times are the candidates.
4.  What the parts of a candidate count is looked up where they lie: the parts that were asked for in a range are composed with the transducer of its
    candidates, level by level.  (A part is found at least as often as the whole, so it is a candidate or a word.)

The bitmaps have ``BITS`` bits each, whatever the input.  They only leave out what can't be a candidate: as they fill, more is
shuffled, but no result changes, since words are told apart by their bytes between blocks and candidates by their own counts.  Within a block words are told apart by 62-bit hashes.
A frequent word or pair is one entry of each block, and a range is bounded by the number of ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.llm.textops import Hasher, Scratch, chunks, lookup, mix, ship, small, stride, text_of

BLOCK_BYTES = 8 << 20
RANGE_WORDS = 500_000
BATCH = 1 << 16
BITS = 1 << 27
UNKNOWN = "und"
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Transducer(NamedTuple):
    """State s has the arcs first[s] to first[s + 1], in the order of their labels; state 0 has none.  Labels count from 1 in ``names``, which is sorted."""

    names: np.ndarray
    first: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray
    root: int

    def expand(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: its label sequences in order, and their weights."""
        state, rows = np.array([self.root]), np.zeros((1, 0), np.int64)
        while len(state):
            n = self.first[state + 1] - self.first[state]
            arc = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[state], n)
            rows = np.column_stack([np.repeat(rows, n, axis=0), self.label[arc]])
            state = self.target[arc]
            if not len(arc):
                return
            yield rows, self.weight[arc]

    def compose(self, rows: np.ndarray) -> np.ndarray:
        """The weights of label sequences (each a row, followed by zeros), 0 for those that the transducer doesn't have."""
        arcs = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) << 32 | self.label
        state, weight = np.full(len(rows), self.root), np.zeros(len(rows), np.int64)
        for column in rows.T:
            on = np.flatnonzero((column > 0) & (state >= 0))
            key = state[on] << 32 | column[on]
            at = np.minimum(np.searchsorted(arcs, key), max(len(arcs) - 1, 0))
            hit = arcs[at] == key if len(arcs) else np.zeros(len(on), bool)
            state[on] = np.where(hit, self.target[at], -1) if len(arcs) else -1
            weight[on] = np.where(hit, self.weight[at], 0) if len(arcs) else 0
        return weight

    def dump(self) -> bytes:
        names = b" ".join(self.names)
        return packed([np.frombuffer(names, np.uint8), self.first, self.label, self.weight, self.target, np.array([self.root])])

    @staticmethod
    def load(data: bytes) -> Transducer:
        names, *parts, root = unpacked(data)
        return Transducer(named(names.astype(np.uint8).tobytes().split(b" ") if len(names) else []), *parts, int(root[0]))


def named(words: list[bytes]) -> np.ndarray:
    out = np.empty(len(words), object)
    out[:] = words
    return out


def packed(arrays: list[np.ndarray]) -> bytes:
    """Whole numbers from 0 on, each array in the narrowest type that holds it."""
    out = []
    for x in arrays:
        top = int(x.max()) if len(x) else 0
        code = next(k for k in (1, 2, 4, 8) if top < 1 << 8 * k)
        out += [np.array([code, len(x)], "<u4").tobytes(), x.astype(f"<u{code}").tobytes()]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        code, n = np.frombuffer(data, "<u4", 2, at).tolist()
        out.append(np.frombuffer(data, f"<u{code}", n, at + 8).astype(np.int64))
        at += 8 + code * n
    return out


class Builder:
    """Makes a transducer from batches of sorted label sequences of two labels at least; no two batches share a prefix of two."""

    def __init__(self):
        self.register: dict[bytes, int] = {}
        self.sizes, self.arcs = [np.zeros(1, np.int64)], []
        self.pairs: list[np.ndarray] = []

    def _states(self, parent: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """The state of each run of equal parents, from its arcs (label, weight, target)."""
        lo = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        hi = np.r_[lo[1:], len(parent)]
        data, register, out, new = np.ascontiguousarray(arcs).tobytes(), self.register, [], []
        for k, (a, b) in enumerate(zip((24 * lo).tolist(), (24 * hi).tolist(), strict=True)):
            key = data[a:b]
            state = register.get(key)
            if state is None:
                state = register[key] = len(register) + 1
                new.append(k)
            out.append(state)
        n = hi[new] - lo[new]
        self.sizes.append(n)
        self.arcs.append(arcs[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[new], n)])
        return np.array(out, np.int64)

    def add(self, rows: np.ndarray, weight: np.ndarray, summed: bool) -> None:
        """``rows`` are distinct, sorted and filled up with zeros.  If ``summed``, a prefix weighs what all rows that begin with it weigh; else its own row's weight."""
        if not len(rows):
            return
        depth, total = rows.shape[1], np.r_[0, np.cumsum(weight)]
        change = np.ones(len(rows), np.int64)  # the first column in which a row differs from the one before, counted from 1
        change[1:] = (rows[1:] != rows[:-1]).argmax(1) + 1
        below, state = None, None
        for d in range(depth, 1, -1):
            at = np.flatnonzero((change <= d) & (rows[:, d - 1] > 0))
            node = np.searchsorted(at, np.arange(len(rows)), "right") - 1
            mine = np.zeros(len(at), np.int64)
            if below is not None and len(below):
                mine[node[below[np.r_[True, node[below[1:]] != node[below[:-1]]]]]] = self._states(node[below], np.column_stack([rows[below, d], self._weights(rows, weight, total, below, d + 1, change, summed), state]))
            below, state = at, mine
        self.pairs.append(np.column_stack([rows[below, 0], rows[below, 1], self._weights(rows, weight, total, below, 2, change, summed), state]))

    @staticmethod
    def _weights(rows: np.ndarray, weight: np.ndarray, total: np.ndarray, at: np.ndarray, d: int, change: np.ndarray, summed: bool) -> np.ndarray:
        if summed:
            # a node of depth d ends where a row differs in one of its first d columns
            cuts = np.append(np.flatnonzero(change <= d), len(rows))
            return total[cuts[np.searchsorted(cuts, at, "right")]] - total[at]
        own = (rows[at, d] == 0) if d < rows.shape[1] else np.ones(len(at), bool)
        return np.where(own, weight[at], 0)

    def finish(self, names: np.ndarray) -> Transducer:
        root = 0
        if self.pairs:
            pairs = np.concatenate(self.pairs)
            state = self._states(pairs[:, 0], pairs[:, 1:])
            word = pairs[np.r_[True, pairs[1:, 0] != pairs[:-1, 0]], 0]
            root = int(self._states(np.zeros(len(word)), np.column_stack([word, np.zeros_like(word), state]))[0])
        arcs = np.concatenate(self.arcs) if self.arcs else np.zeros((0, 3), np.int64)
        return Transducer(names, np.r_[0, np.cumsum(np.concatenate(self.sizes))], *arcs.T, root)


def build(names: np.ndarray, rows: np.ndarray, weight: np.ndarray, summed: bool) -> Transducer:
    """From sorted sequences of labels (1 to len(names), of which only those that occur are kept), in batches that end with a prefix of two."""
    used = np.unique(np.append(rows.ravel(), 0))
    rows = np.searchsorted(used, rows)
    builder = Builder()
    edges = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])[: len(rows)]
    at = np.unique(np.searchsorted(edges, np.arange(0, len(rows), BATCH)))
    cuts = edges[at[at < len(edges)]]
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)][: len(cuts)], strict=True):
        builder.add(rows[lo:hi], weight[lo:hi], summed)
    return builder.finish(names[used[1:] - 1])


def distinct(rows: np.ndarray, weight: np.ndarray, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts label sequences (by ``head`` first) and adds up the weights of equal ones: rows, weights, head."""
    keys = [rows[:, j] << 32 | (rows[:, j + 1] if j + 1 < rows.shape[1] else 0) for j in range(0, rows.shape[1], 2)][::-1]
    head = np.zeros(len(rows), np.int64) if head is None else head
    order = np.lexsort([*keys, head])
    rows, weight, head = rows[order], weight[order], head[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.add.reduceat(weight, first) if len(first) else weight, head[first]


def runs_of(head: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal numbers begins and ends."""
    edges = np.flatnonzero(head[1:] != head[:-1]) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(head)], strict=True)) if len(head) else []


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * stride(3) + second) >> np.uint64(32)


class Bitmap:
    """A set of numbers below BITS."""

    def __init__(self, spark: SparkSession, numbers: DataFrame):
        """From a column of numbers; what reaches the driver is BITS / 8 bytes at most."""
        x = numbers.columns[0]
        place = F.col(x) % BITS + 1
        parts = numbers.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
        bits = np.zeros(BITS // 8, np.uint8)
        for part, data in zip(parts["part"].to_pylist(), parts["bits"].to_pylist(), strict=True):
            bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(data, np.uint8)
        self.held = spark.sparkContext.broadcast(bits)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers.astype(np.int64) % BITS
        return (self.held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Words(NamedTuple):
    """The words of one language in a block: hashes, whether each begins a piece, and how to get at their bytes."""

    hashes: np.ndarray
    fresh: np.ndarray
    parts: list[tuple[int, bytes, np.ndarray, np.ndarray]]

    def bytes_at(self, places: np.ndarray) -> list[bytes]:
        stop = np.cumsum([x[0] for x in self.parts])
        part = np.searchsorted(stop, places, "right")
        at = places - np.r_[0, stop[:-1]][part]
        return [self.parts[p][1][self.parts[p][2][k] : self.parts[p][3][k]] for p, k in zip(part.tolist(), at.tolist(), strict=True)]


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[dict[str, Words]]:
    """The words of batches of lang and text, in blocks."""
    held: dict[str, list] = {}
    size = 0

    def done() -> dict[str, Words]:
        out = {lang: Words(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), [(len(x[0]), *x[2:]) for x in parts]) for lang, parts in held.items()}
        held.clear()
        return out

    for batch in small(batches):
        langs = batch.column(0).to_pylist()
        for chunk in chunks(text_of(batch)):
            buf = _LOWER[chunk.buf]
            starts, ends, text = chunk.runs(_WORD)
            if not len(starts):
                continue
            hashes, data = Hasher(buf)(starts, ends), buf.tobytes()
            piece = np.cumsum(_BREAK[buf])[starts]
            fresh = np.r_[True, piece[1:] != piece[:-1]]
            own = langs[chunk.lo : chunk.hi]
            code = {g: k for k, g in enumerate(dict.fromkeys(own))}
            kind = np.array([code[g] for g in own])[text]
            for lang, k in code.items():
                mine = np.flatnonzero(kind == k)
                if len(mine):
                    held.setdefault(lang, []).append((mix(hashes[mine] + stride(crc32(lang.encode()) + 1)), fresh[mine], data, starts[mine], ends[mine]))
            size += len(data)
            if size > block_bytes:
                yield done()
                size = 0
    yield done()


def word_counts(docs: DataFrame, block_bytes: int) -> DataFrame:
    """lang, word, bucket, f: all words; the bucket is what the bitmap knows of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_bytes):
            for lang, words in block.items():
                keys, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
                names = pa.array(words.bytes_at(first), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), names, pa.array((keys >> np.uint64(32)).astype(np.int64)), pa.array(n)], ["lang", "word", "bucket", "n"])

    return docs.mapInArrow(run, "lang string, word string, bucket long, n long").groupBy("lang", "word", "bucket").agg(F.sum("n").alias("f"))


def common_pairs(docs: DataFrame, common: Bitmap, least: int, ranges: int, block_bytes: int) -> DataFrame:
    """key: 32-bit hashes that all pairs of neighbouring frequent words with this hash together reach ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_bytes):
            found = [np.zeros(0, np.uint64)]
            for words in block.values():
                ok = common.has(words.hashes >> np.uint64(32))
                at = np.flatnonzero(ok[:-1] & ok[1:] & ~words.fresh[1:])
                found.append(pair_keys(words.hashes[at], words.hashes[at + 1]))
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            head = (keys * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            runs = runs_of(head)
            data = [packed([np.diff(keys[lo:hi], prepend=keys[lo : lo + 1]), keys[lo : lo + 1], n[lo:hi]]) for lo, hi in runs]
            yield pa.RecordBatch.from_arrays([pa.array(head[[lo for lo, _ in runs]], pa.int64()), pa.array(data, pa.binary())], ["range", "data"])

    def total(table: pa.Table) -> pa.Table:
        parts = [unpacked(x.as_py()) for x in table["data"]]
        keys, n = np.concatenate([start + np.cumsum(steps) for steps, start, _ in parts]), np.concatenate([x[2] for x in parts])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return pa.table({"key": keys[first[np.add.reduceat(n, first) >= least]]})

    return docs.mapInArrow(run, "range long, data binary").groupBy("range").applyInArrow(total, "key long")


def grams(words: np.ndarray, follows: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that a word follows on, and the words' labels from there on, up to ``longest``, then zeros; ``follows`` says which words may follow the one before them."""
    gap = np.append(np.flatnonzero(~follows), len(words))
    left = gap[np.searchsorted(gap, np.arange(len(words)), "right")] - np.arange(len(words))
    at = np.flatnonzero(left > 1)
    left = left[at]
    rows = np.zeros((len(at), longest), np.int64)
    for j in range(longest):
        on = left > j
        rows[on, j] = words[at[on] + j]
    return at, rows


def prefix_range(lang: str, first: bytes, second: bytes, ranges: int) -> int:
    return crc32(b" ".join([lang.encode(), first, second])) % ranges


def transducers(docs: DataFrame, common: Bitmap, pairs: Bitmap, longest: int, ranges: int, block_bytes: int) -> DataFrame:
    """range, lang, data: the count transducers of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_bytes):
            for lang, words in block.items():
                ok = common.has(words.hashes >> np.uint64(32))
                follows = np.zeros(len(ok), bool)
                follows[1:] = ok[1:] & ok[:-1] & ~words.fresh[1:]
                at = np.flatnonzero(follows)
                follows[at] = pairs.has(pair_keys(words.hashes[at - 1], words.hashes[at]))
                part = np.flatnonzero(follows | np.r_[follows[1:], False])
                _, first, of = np.unique(words.hashes[part], return_index=True, return_inverse=True)
                names = named(words.bytes_at(part[first]))
                order = np.argsort(names)
                label = np.zeros(len(ok), np.int64)
                label[part] = np.argsort(order)[of] + 1
                names = names[order]
                _, rows = grams(label, follows, longest)
                rows, weight, _ = distinct(rows, np.ones(len(rows), np.int64))
                two = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)][: len(rows)]
                prefixes = rows[two, :2]
                head = np.array([prefix_range(lang, names[a - 1], names[b - 1], ranges) for a, b in prefixes.tolist()], np.int64)[np.cumsum(two) - 1] if len(rows) else np.zeros(0, np.int64)
                order = np.argsort(head, kind="stable")
                rows, weight, head = rows[order], weight[order], head[order]
                runs = runs_of(head)
                data = [build(names, rows[lo:hi], weight[lo:hi], True).dump() for lo, hi in runs]
                yield pa.RecordBatch.from_arrays([pa.array(head[[lo for lo, _ in runs]], pa.int64()), pa.array([lang] * len(runs), pa.string()), pa.array(data, pa.binary())], ["range", "lang", "data"])

    return docs.mapInArrow(run, "range long, lang string, data binary")


def united(transducers: list[Transducer], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names; all sequences of two labels and more, sorted and filled up with zeros; their summed weights."""
    names = named(sorted(set().union(*[t.names for t in transducers])))
    number = {x: k + 1 for k, x in enumerate(names)}
    rows, weight = [np.zeros((0, longest), np.int64)], [np.zeros(0, np.int64)]
    for t in transducers:
        label = np.array([0, *(number[x] for x in t.names)])
        for found, n in t.expand():
            if found.shape[1] > 1:
                wide = np.zeros((len(found), longest), np.int64)
                wide[:, : found.shape[1]] = label[found]
                rows.append(wide)
                weight.append(n)
        if sum(map(len, rows[1:])) > 1 << 21:
            rows, weight = ([x] for x in distinct(np.concatenate(rows), np.concatenate(weight))[:2])
    return names, *distinct(np.concatenate(rows), np.concatenate(weight))[:2]


def candidates(found: DataFrame, least: int, longest: int) -> DataFrame:
    """pid, range, lang, words and a of all n-grams of two words and more that all blocks together have ``least`` times."""

    def run(table: pa.Table) -> pa.Table:
        out, number, held = [], int(table["range"][0].as_py()) << 32, {}
        for lang, data in zip(table["lang"].to_pylist(), table["data"], strict=True):
            held.setdefault(lang, []).append(Transducer.load(data.as_py()))
        for lang, parts in sorted(held.items()):
            names, rows, weight = united(parts, longest)
            kept = np.flatnonzero(weight >= least)
            rows, weight = rows[kept], weight[kept]
            stop = pa.array(np.r_[0, np.cumsum((rows > 0).sum(1))], pa.int32())
            words = pa.ListArray.from_arrays(stop, pa.array(names[rows[rows > 0] - 1], pa.binary()).cast(pa.string()))
            n = len(rows)
            out.append(pa.table({"pid": number + np.arange(n), "range": np.full(n, number >> 32), "lang": pa.array([lang] * n, pa.string()), "words": words, "a": weight}))
            number += n
        return pa.concat_tables(out)

    return found.groupBy("range").applyInArrow(run, "pid long, range long, lang string, words array<string>, a long")


def _labels(lists: pa.ChunkedArray, number: dict[str, int], longest: int) -> np.ndarray:
    """Lists of words as rows of labels, filled up with zeros; an unknown word gets the label after the last."""
    out = np.zeros((len(lists), longest), np.int64)
    for row, words in zip(out, lists.to_pylist(), strict=True):
        row[: len(words)] = [number.get(x, len(number) + 1) for x in words]
    return out


def _look_up(left: pa.Table, right: pa.Table, longest: int) -> pa.Table:
    """What the parts asked for in one range count."""
    out = []
    for lang in sorted(set(right["lang"].to_pylist())):
        mine, asked = left.filter(pc.equal(left["lang"], lang)), right.filter(pc.equal(right["lang"], lang))
        names = sorted({x for own in mine["words"].to_pylist() for x in own})
        number = {x: k + 1 for k, x in enumerate(names)}
        rows, weight, _ = distinct(_labels(mine["words"], number, longest), mine["a"].to_numpy())
        held = build(named([x.encode() for x in names]), rows, weight, False)
        out.append(asked.select(["pid", "k", "side"]).append_column("f", pa.array(held.compose(_labels(asked["part"], number, longest)))))
    empty = pa.table({"pid": pa.array([], pa.int64()), "k": pa.array([], pa.int32()), "side": pa.array([], pa.string()), "f": pa.array([], pa.int64())})
    return pa.concat_tables(out) if out else empty


def _range_column(lang: Column, words: Column, ranges: int) -> Column:
    return F.crc32(F.concat_ws(" ", lang, words[0], words[1]).cast("binary")) % ranges


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, inside: int = 100, top: int = 2000, block_bytes: int = BLOCK_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """The ``top`` best phrases of each language of ``docs`` (lang, text; other columns are left): lang, rank, phrase, a, l, r, n, score.

    A-Z are made small; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``.  ``n`` counts a language's words, ``a`` a phrase's places within pieces (2 to ``longest`` words,
    ``least`` places).  A cut gives score floor(1000 * a * n / (l * r)) with l and r the places of its two parts; the cut with the lowest score counts, the earliest of equal ones.
    A phrase goes if its words lie side by side in a longer candidate found at least ``inside`` hundredths as often.  Order: score, a, both falling, then phrase by its bytes.

    A null lang is ``und``; null and empty texts have no words; rows that repeat count as often as they are there; a language without candidates, and an empty table, give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text").where("text IS NOT NULL")
    counts = scratch.put(word_counts(rows, block_bytes))
    totals = scratch.put(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    common = scratch.put(counts.where(F.col("f") >= least).select(F.concat_ws("\t", "lang", "word").alias("key"), "bucket", "f"))  # a word has no tab
    scratch.drop(counts)
    known = Bitmap(spark, common.select("bucket"))
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (totals.agg(F.sum("n")).first()[0] or 0) // range_words)
    pairs = Bitmap(spark, common_pairs(rows, known, least, ranges, block_bytes))
    phrases = scratch.put(candidates(transducers(rows, known, pairs, longest, ranges, block_bytes), least, longest))

    size = F.size("words")
    cut = phrases.select("pid", "lang", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    left, right = F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, size)
    parts = cut.select("pid", "lang", "k", F.explode(F.array(F.struct(F.lit("l").alias("side"), left.alias("part")), F.struct(F.lit("r").alias("side"), right.alias("part")))).alias("x")).select("pid", "lang", "k", "x.side", "x.part")
    asked = parts.where(F.size("part") > 1).withColumn("range", _range_column(F.col("lang"), F.col("part"), ranges))
    looked_up = phrases.select("range", "lang", "words", "a").groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(lambda x, y: _look_up(x, y, longest), "pid long, k int, side string, f long")
    single = scratch.put(parts.where(F.size("part") == 1).select("pid", "k", "side", F.concat_ws("\t", "lang", F.col("part")[0]).alias("key")))
    single = lookup(single, common.select("key", "f"), "key").select("pid", "k", "side", "f")
    both = looked_up.unionByName(single).groupBy("pid", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))

    # the highest count of a longer candidate around each phrase
    longer = phrases.where(size > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("m")).select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("s"))
    around = longer.select("lang", F.array_join(F.slice("words", F.col("s"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.select("pid", "lang", F.array_join("words", " ").alias("phrase"), "a").join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))

    exact = lambda c: F.col(c).cast("decimal(20,0)")
    scored = both.join(kept.select("pid", "lang", "phrase", "a"), "pid").join(F.broadcast(totals), "lang")  # totals: a row a language
    scored = scored.withColumn("top", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).withColumn("bottom", exact("l") * exact("r")).withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("pid", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("pid", "lang", "phrase", "a", "n", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that no task sorts all of its phrases
    some = best.withColumn("part", F.pmod(F.xxhash64("pid"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
