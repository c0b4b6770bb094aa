"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit distances.

Texts are sequences of lower-cased words (letters and digits).  A document is contaminated by an item if some stretch of it can be
turned into the item by at most ``edit_share`` of the item's words, rounded down, in insertions, deletions and replacements.
An item of fewer than ``1 / edit_share`` words must therefore occur word by word.

*Windows.*  For each size of items, windows of that size are laid at every start of a document where they can match any item:
the q-gram lemma asks for ``n - q + 1 - q * edits`` runs of q words that items of this size hold, and a count of such
runs, which asks for no particular item, leaves out the starts that have fewer.  No match fails that count.

*Embedding.*  A walk reads a sequence from its first word on and writes the word it stands at; a random bit of word and step says
whether it moves on.  Two sequences at a small edit distance are thus written to words at a small Hamming
distance (Chakraborty, Goldenberg and Koucky).

*LSH.*  A key is what a walk wrote at a few sampled steps.  Windows that share a key with an item of their size are candidates.
For each size, walks are doubled and steps in a key are reduced until the share of pairs at the very bound, made up in several mixes of
edits, that meet in a key reaches ``recall``; should it not get there, every item of the size is a candidate of its windows.

*Verification.*  Neighbouring candidate windows of one item make a cluster, which is verified by an exact edit distance against
the document's words around it.

Items are held as arrays on every task, about ``block_bytes`` of their texts at once; more are run block after block.  Nothing is shuffled.
Null or empty texts match nothing; repeated items count once, repeated rows and rows that repeat a doc_id are judged each by itself.
Of the windows of a cluster the last one is reported from which on the item can be found at its least number of edits, of clusters the first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.textops import Chunk, Hasher, chunks, mix, ship, small, stride, text_of
from weekloom.llm.words import lowered

INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
KEYS = 16
#: Steps in a key and the most walks with so many, in the order in which they are tried.
WIDTHS = ((3, 8), (2, 16), (1, 64))
_FLAGS = 20


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word."""
    starts, ends, text = chunk.runs(INSIDE)
    return Hasher(lowered(chunk.buf))(starts, ends), text


def runs_of(words: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q words from each place on."""
    n = max(len(words) - q + 1, 0)
    out = np.full(n, q, np.uint64)
    for j in range(q):
        out = mix(out * stride(1) + words[j : j + n])
    return out


def nearest(item: list[int], stretch: list[int], most: int) -> int | None:
    """Least edit distance of the item to any substring of the stretch, if at most ``most`` (bit-parallel, by Myers)."""
    size, places = len(item), defaultdict(int)
    for i, x in enumerate(item):
        places[x] |= 1 << i
    full, high = (1 << size) - 1, 1 << (size - 1)
    more, less, score, best = full, 0, size, size
    for y in stretch:
        same = places.get(y, 0)
        down = same | less
        across = ((((same & more) + more) ^ more) | same) & full
        up, off = less | (full & ~(across | more)), more & across
        score += bool(up & high) - bool(off & high)
        best = min(best, score)
        up, off = up << 1 & full, off << 1 & full
        more, less = off | (full & ~(down | up)), up & down
    return best if best <= most else None


def keys(rows: np.ndarray, walks: int, sample: int) -> np.ndarray:
    """Rows of n word hashes each to rows x (walks * KEYS) keys, each of ``sample`` steps of a walk."""
    count, n = rows.shape
    wanted = mix(np.arange(1, walks * KEYS * sample + 1, dtype=np.uint64) * stride(7) + np.uint64(n)) % np.uint64(max(2 * n - 1, 1))
    wanted = wanted.astype(np.int64).reshape(walks, KEYS, sample)
    out = np.zeros((count, walks, KEYS), np.uint64)
    padded = np.concatenate([rows, np.zeros((count, 1), np.uint64)], axis=1).reshape(-1)  # a place behind the end
    line = np.arange(count) * (n + 1)
    for w in range(walks):
        at, uses = line.copy(), defaultdict(list)
        for k, s in np.ndindex(KEYS, sample):
            uses[int(wanted[w, k, s])].append((k, s))
        bits = padded
        for step in range(max(uses) + 1):
            if step % 64 == 0:  # the bits of the next 64 steps for every word
                bits = mix(padded + stride(1 + w * 1009 + step // 64))
            for k, s in uses.get(step, ()):
                out[:, w, k] += mix(padded[at] + stride(3 + s))
            at = np.minimum(at + (bits[at] >> np.uint64(step % 64) & np.uint64(1)).astype(np.int64), line + n)
    return mix(out + mix(np.arange(walks * KEYS, dtype=np.uint64) + np.uint64(n << 20)).reshape(walks, KEYS)).reshape(count, -1)


@lru_cache(1000)
def walks_for(n: int, edits: int, recall: float) -> tuple[int, int]:
    """Walks and steps in a key by which a share of ``recall`` of pairs of n words at ``edits`` edits meet; no walks if none will do."""
    if not edits:
        return 1, 3
    draw, pairs = np.random.default_rng(n), min(max(40_000 // n, 48), 256)
    rows, edited = draw.integers(1, 1 << 63, (pairs, n)).astype(np.uint64), []
    for mixture in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)):  # replacements, insertions, deletions
        for row in rows:
            kinds = draw.choice(3, edits, p=np.array(mixture) / sum(mixture))
            at = draw.permutation(n)
            gone, fresh = at[: (kinds == 2).sum()], at[(kinds == 2).sum() : (kinds != 1).sum()]
            new = row.copy()
            new[fresh] = draw.integers(1, 1 << 63, len(fresh))
            added = draw.integers(0, n, (kinds == 1).sum())
            new = np.insert(np.delete(new, gone), np.minimum(added, n - len(gone)), draw.integers(1, 1 << 63, len(added)).astype(np.uint64))
            edited.append(np.concatenate([new, draw.integers(1, 1 << 63, edits).astype(np.uint64)])[:n])
    edited = np.array(edited)
    for sample, most in WIDTHS:
        walks = 1
        while walks <= most:
            met = (keys(edited, walks, sample).reshape(4, pairs, -1) == keys(rows, walks, sample)[None]).any(axis=2)
            if met.mean(axis=1).min() >= recall:
                return walks, sample
            walks *= 2
    return 0, 0


def rounded(n: int) -> int:
    """The next power of 1.25: the more words, the more walks are needed at one share of edits, so walks are found for these sizes only."""
    return int(np.ceil(1.25 ** np.ceil(np.log(n) / np.log(1.25) - 1e-9)))


class Size:
    """The items of one number of words: the runs of q words they hold, and their keys."""

    def __init__(self, items: list[int], rows: np.ndarray, edit_share: float, plan: dict[int, tuple[int, int]]):
        self.items, self.n = np.array(items), rows.shape[1]
        self.edits = int(np.floor(self.n * edit_share + 1e-9))
        self.q = min(max((self.n - self.edits) // (self.edits + 1), 1), 3)
        self.need = max(self.n - self.q + 1 - self.q * self.edits, 1)
        self.grams = np.unique(np.concatenate([runs_of(row, self.q) for row in rows]))
        self.walks, self.sample = plan[self.n]
        if self.walks:
            own = keys(rows, self.walks, self.sample)
            order = np.argsort(own, axis=None, kind="stable")
            self.keys, self.of = own.reshape(-1)[order], order // own.shape[1]

    def starts(self, at: np.ndarray, text: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Starts, as places among all words, of windows that hold enough of the runs that begin at places ``at``."""
        if len(at) < self.need:
            return at[:0]
        first, last = at[: len(at) - self.need + 1], at[self.need - 1 :]
        fits = (last - first <= self.n - self.q) & (text[first] == text[last])
        first, last = first[fits], last[fits]
        lo = np.maximum(last - self.n + self.q, low[text[first]])
        lo = np.maximum(lo, np.concatenate(([-1], first[:-1])) + 1)  # both grow, so each start comes once
        span = np.maximum(first - lo + 1, 0)
        return np.repeat(lo - np.cumsum(span) + span, span) + np.arange(span.sum())

    def candidates(self, words: np.ndarray, starts: np.ndarray, text: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and items whose keys meet; a window that the text ends within is filled up with nothing."""
        step = max((1 << 20) // self.n, 1)
        for lo in range(0, len(starts), step):
            begin = starts[lo : lo + step]
            if not self.walks:
                yield np.repeat(begin, len(self.items)), np.tile(self.items, len(begin))
                continue
            place = begin[:, None] + np.arange(self.n)
            inside = place < high[text[begin]][:, None]
            rows = np.where(inside, words[np.minimum(place, len(words) - 1)], np.uint64(0))
            own = keys(rows, self.walks, self.sample)
            left, right = np.searchsorted(self.keys, own.reshape(-1)), np.searchsorted(self.keys, own.reshape(-1), "right")
            times = right - left
            hit = np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())
            window = np.repeat(np.arange(own.size) // own.shape[1], times)
            pair = np.unique(window * len(self.items) + self.of[hit])
            yield begin[pair // len(self.items)], self.items[pair % len(self.items)]


class Items:
    """A block of items, by size."""

    def __init__(self, rows: list[tuple[int, bytes]], edit_share: float, plan: dict[int, tuple[int, int]]):
        chunk = Chunk(0, [t for _, t in rows])
        words, text = word_hashes(chunk)
        cuts = np.searchsorted(text, np.arange(len(rows) + 1))
        every = [(i, words[a:b]) for (i, _), a, b in zip(rows, cuts[:-1], cuts[1:], strict=True) if b > a]
        self.ids, self.words = [i for i, _ in every], [w for _, w in every]
        groups = defaultdict(list)
        for k, w in enumerate(self.words):
            groups[len(w)].append(k)
        self.sizes = [Size(own, np.array([self.words[k] for k in own]), edit_share, plan) for _, own in sorted(groups.items())]
        # which sizes hold a run of words, for all runs of the same q together
        self.grams = {}
        for q in {s.q for s in self.sizes}:
            own = [k for k, s in enumerate(self.sizes) if s.q == q]
            hashes = np.concatenate([self.sizes[k].grams for k in own])
            of = np.repeat(own, [len(self.sizes[k].grams) for k in own])
            order = np.argsort(hashes, kind="stable")
            distinct, first, times = np.unique(hashes[order], return_index=True, return_counts=True)
            flags = np.zeros(1 << _FLAGS, bool)
            flags[distinct & np.uint64((1 << _FLAGS) - 1)] = True
            self.grams[q] = flags, distinct, first, times, of[order]

    def windows(self, words: np.ndarray, text: np.ndarray, low: np.ndarray) -> Iterator[tuple[Size, np.ndarray]]:
        """The sizes that have windows in these texts, with their starts."""
        for q, (flags, distinct, first, times, of) in self.grams.items():
            hashes = runs_of(words, q)
            at = np.flatnonzero(flags[hashes & np.uint64((1 << _FLAGS) - 1)])
            at = at[text[at] == text[at + q - 1]]
            found = np.minimum(np.searchsorted(distinct, hashes[at]), len(distinct) - 1)
            same = distinct[found] == hashes[at]
            at, found = at[same], found[same]
            n = times[found]
            size = of[np.repeat(first[found] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            at = np.repeat(at, n)
            order = np.argsort(size, kind="stable")
            size, at = size[order], at[order]
            cuts = np.append(np.flatnonzero(np.diff(size, prepend=-1)), len(size))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                chosen = self.sizes[size[a]]
                starts = chosen.starts(at[a:b], text, low)
                if len(starts):
                    yield chosen, starts

    def matches(self, chunk: Chunk) -> list[tuple[int, int, int, int, int]]:
        """(text, item's id, edits, the item's words, the best window's first word in the text) of each text and item that match."""
        words, text = word_hashes(chunk)
        if not len(words) or not self.ids:
            return []
        bounds = np.searchsorted(text, np.arange(len(chunk.texts) + 1))
        low, high = bounds[:-1], bounds[1:]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for size, starts in self.windows(words, text, low):
            n, slack = size.n, size.edits
            for begin, item in size.candidates(words, starts, text, high):
                order = np.lexsort((begin, text[begin], item))
                begin, item = begin[order], item[order]
                of = text[begin]
                fresh = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (of[1:] != of[:-1]) | (begin[1:] - begin[:-1] > n)][: len(begin)])
                for a, b in zip(fresh.tolist(), [*fresh[1:].tolist(), len(begin)], strict=True):
                    t, k = int(of[a]), int(item[a])
                    sought = self.words[k].tolist()
                    around = lambda lo, hi: words[max(low[t], lo - slack) : min(high[t], hi + n + slack)].tolist()  # noqa: B023, E731
                    most = min(slack, best[t, k][0] - 1) if (t, k) in best else slack
                    edits = nearest(sought, around(begin[a], begin[b - 1]), most) if most >= 0 else None
                    if edits is not None:
                        own, end = begin[a:b].tolist(), min(high[t], begin[b - 1] + n + slack)
                        later = bisect_left(own, True, lo=1, key=lambda x: nearest(sought, words[x:end].tolist(), edits) is None)  # noqa: B023
                        best[t, k] = edits, own[later - 1] - int(low[t])
        return [(t, self.ids[k], e, len(self.words[k]), s) for (t, k), (e, s) in best.items()]


_built: dict[str, Items] = {}


def built(name: str, block: tuple) -> Items:
    """The index of a block, made once by each Python worker."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(*block)
    return _built[name]


def item_blocks(benchmark: DataFrame, edit_share: float, recall: float, block_bytes: int) -> Iterator[tuple[str, object]]:
    """Name and broadcast of each block of items, one after the other; a block is as large as its share of all bytes, give or take an item."""
    spark = ship(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted((r[0], bytes(r[1])) for r in own.collect())
        sizes = set(np.bincount(word_hashes(Chunk(0, [t for _, t in rows]))[1]).tolist()) - {0}
        most = lambda n: int(np.floor(n * edit_share + 1e-9))
        plan = {n: walks_for(rounded(n) if most(n) else n, most(rounded(n)) if most(n) else 0, recall) for n in sorted(sizes)}
        held = spark.sparkContext.broadcast((rows, edit_share, plan))
        yield f"{spark.sparkContext.applicationId}-{held._jbroadcast.id()}", held


def contaminated(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.2, recall: float = 0.99, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, n_edits, n_item_words, start_word: a row per document (row) and item that match."""
    schema = "doc_id long, item_id long, n_edits long, n_item_words long, start_word long"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where("text IS NOT NULL")
    out = None
    for name, held in item_blocks(benchmark, edit_share, recall, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], name=name, held=held) -> Iterator[pa.RecordBatch]:
            index = built(name, held.value)
            for batch in small(batches):
                ids = batch.column(0).to_pylist()
                found = [(ids[c.lo + t], *rest) for c in chunks(text_of(batch)) for t, *rest in index.matches(c)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [[]] * 5)], ["doc_id", "item_id", "n_edits", "n_item_words", "start_word"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def matching(name: str, held):
    """Of texts: whether one matches any item of the block."""

    @F.arrow_udf("boolean")
    def matched(texts: pa.Array) -> pa.Array:
        index, hit = built(name, held.value), np.zeros(len(texts), bool)
        for chunk in chunks(texts):
            for t, *_ in index.matches(chunk):
                hit[chunk.lo + t] = True
        return pa.array(hit)

    return matched


def decontaminate(docs: DataFrame, benchmark: DataFrame, edit_share: float = 0.2, recall: float = 0.99, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows that match no item, with all columns; each row is judged by its own text, whatever its doc_id."""
    for name, held in item_blocks(benchmark, edit_share, recall, block_bytes):
        docs = docs.where(~matching(name, held)(docs["text"]))
    return docs
