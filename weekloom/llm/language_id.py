"""Language identification by unigrams marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  The probability of a word is
the sum, over all ways to cut it into pieces, of the product of their probabilities; the forward algorithm
takes that sum from left to right, for many words at once, in logarithms, so that a word may be of any length.  The piece probabilities come from expectation-maximisation (forward and
backward sums) over the counts of all words of all training texts: the counts stay in Spark, and only the
expected counts by language and piece, as many as the vocabulary has pieces, come to the driver.

A text's language is that with the largest prior times product of its words' probabilities (of equals, the first by name).  ``score`` is its
posterior.  A null text or one without a letter is ``und`` with score 0, as is any text if nothing was learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.pretokens import default_path
from weekloom.llm.textops import Hasher, Scratch, chunks, ship, small, text_of
from weekloom.llm.words import LETTERS, letter_words, lowered, word_counts

UND = "und"
FLOOR = 1e-7


class Pieces:
    """Looks up the piece of a hash; 0 where there is none.  Single bytes always have one."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {bytes([b]) for b in range(128, 256)} | {bytes([b]) for b in range(97, 123)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                text = model.id_to_piece(i).removeprefix("▁").encode()
                if text and LETTERS[list(text)].all():
                    texts.add(lowered(np.frombuffer(text, np.uint8)).tobytes())
        self.texts = sorted(texts)
        self.lengths = sorted(set(map(len, self.texts)))
        buf = np.frombuffer(b"".join(self.texts), np.uint8)
        ends = np.cumsum([len(x) for x in self.texts])
        hashes = Hasher(buf)(np.r_[0, ends[:-1]], ends)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], order + 1
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.keys & np.uint64((1 << 22) - 1)] = True

    def __len__(self) -> int:
        return len(self.texts) + 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.filter[hashes & np.uint64((1 << 22) - 1)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == hashes[maybe], self.ids[at], 0)
        return out


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """All ways to cut some words into pieces: an arc for each piece that a word holds, from one place to a later one.

    Places are numbered word by word: ``first`` has each word's first place, ``last`` its last.
    """

    def __init__(self, vocabulary: Pieces, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        self.last = np.cumsum(size + 1) - 1
        self.first = self.last - size
        word = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        packed = buf[starts[word] + at]
        left, hasher = size[word] - at, Hasher(packed)
        found = []
        for n in vocabulary.lengths:
            if n > size.max():
                break
            begin = np.flatnonzero(left[: len(packed) - n + 1] >= n)
            piece = vocabulary.find(hasher(begin, begin + n))
            held = np.flatnonzero(piece)
            if len(held):
                found.append((begin[held], np.full(len(held), n), piece[held]))
        begin, n, self.piece = (np.concatenate(x) for x in zip(*found, strict=True))
        self.word = word[begin]
        self.tail = begin + self.word
        self.head = self.tail + n
        self.from_, self.to = at[begin], at[begin] + n

    def sums(self, logs: np.ndarray, back: bool = False) -> np.ndarray:
        """Logarithms, places x languages, of the sums over the ways to cut what lies before (or behind) each place."""
        tail, head, level = (self.head, self.tail, -self.from_) if back else (self.tail, self.head, self.to)
        order = np.lexsort((self.word, level))
        tail, head, piece = tail[order], head[order], self.piece[order]
        cuts = np.flatnonzero(np.diff(level[order])) + 1
        out = np.zeros((int(self.last[-1]) + 1, logs.shape[1]))
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
            value = out[tail[a:b]] + logs[piece[a:b]]
            node = head[a:b]
            run = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            top = np.maximum.reduceat(value, run)
            value = np.exp(value - np.repeat(top, np.diff(np.append(run, b - a)), axis=0))
            out[node[run]] = top + np.log(np.add.reduceat(value, run))
        return out


def blocks(size: np.ndarray, most: int = 1 << 18) -> Iterator[slice]:
    """Consecutive words of about ``most`` bytes together."""
    end, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(int(np.searchsorted(end, (end[lo - 1] if lo else 0) + most)), lo + 1)
        yield slice(lo, hi)
        lo = hi


def expected(words: list[bytes], weight: np.ndarray, vocabulary: Pieces, logs: np.ndarray) -> np.ndarray:
    """Expected number of times that each piece is used in these words of one language (``logs``: pieces x 1)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    lattice = Lattice(vocabulary, np.frombuffer(b"".join(words), np.uint8), ends - size, ends)
    alpha, beta = lattice.sums(logs)[:, 0], lattice.sums(logs, back=True)[:, 0]
    share = np.exp(alpha[lattice.tail] + logs[lattice.piece, 0] + beta[lattice.head] - alpha[lattice.last][lattice.word])
    return np.bincount(lattice.piece, share * weight[lattice.word], len(vocabulary))


def normalised(counts: np.ndarray) -> np.ndarray:
    """Columns of counts made logarithms of probabilities, with a floor; row 0 stands for no piece."""
    return np.log(np.maximum(counts / np.maximum(counts.sum(axis=0), 1e-300), FLOOR))


def learn(training: DataFrame, lang: Column, path: str, rounds: int = 2) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, prior and piece probabilities (pieces x languages), from every text of a non-null language."""
    spark = training.sparkSession
    scratch = Scratch(spark)
    size = len(pieces(path))
    counts = scratch.put(word_counts(training, lang))
    prior = {x["grp"]: x["count"] for x in training.select(lang.cast("string").alias("grp")).where("grp IS NOT NULL").groupBy("grp").count().collect()}
    names = sorted(prior)
    lengths = np.array([0] + [len(x) for x in pieces(path).texts])
    table = normalised(np.repeat((0.02 ** np.minimum(lengths, 4.0))[:, None], max(len(names), 1), axis=1))
    for _ in range(rounds if names else 0):
        held = spark.sparkContext.broadcast((names, table))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            vocabulary, (names, table) = pieces(path), held.value
            sums = np.zeros((len(names), size))
            number = {g: k for k, g in enumerate(names)}
            waiting: dict[str, tuple[list, list, list]] = {g: ([], [], []) for g in names}

            def count(g: str) -> None:
                words, n, _ = waiting.pop(g)
                waiting[g] = [], [], []
                if words:
                    k = number[g]
                    sums[k] += expected(words, np.array(n), vocabulary, table[:, k : k + 1])

            for batch in small(batches):
                for g, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = waiting[g]
                    own[0].append(word)
                    own[1].append(n)
                    own[2].append(len(word))
                for g in names:  # a block of one language's words at once, however they are spread over batches
                    if sum(waiting[g][2]) > 1 << 18:
                        count(g)
            for g in names:
                count(g)
            k, piece = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums[k, piece])], ["k", "piece", "n"])

        found = counts.mapInArrow(run, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toArrow()
        fresh = np.zeros((size, len(names)))
        fresh[found["piece"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
        table = normalised(fresh)
        held.destroy()
    scratch.drop(counts)
    weights = np.array([prior[x] for x in names], float)
    return names, weights / max(weights.sum(), 1), table


def has_letter(text: bytes) -> bool:
    return text.upper() != text.lower() or any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(docs: DataFrame, names: list[str], prior: np.ndarray, table: np.ndarray, path: str) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    held = ship(docs.sparkSession).sparkContext.broadcast((names, np.log(np.maximum(prior, 1e-12)), table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, (names, log_prior, table) = pieces(path), held.value
        memo: dict[int, int] = {}
        logs = np.zeros((1024, len(names)))
        for batch in small(batches):
            pred, score = [], []
            for chunk in chunks(text_of(batch), 2 << 20):
                total = np.zeros((len(chunk.texts), len(names)))
                buf, starts, ends, text = letter_words(chunk)
                if len(starts) and names:
                    hasher = Hasher(buf)
                    keys, first, inverse = np.unique(hasher(starts, ends), return_index=True, return_inverse=True)
                    if len(memo) > 600_000:
                        memo.clear()
                    listed = keys.tolist()
                    fresh = np.array([i for i, k in enumerate(listed) if k not in memo], np.int64)
                    base = len(memo)
                    if base + len(fresh) > len(logs):
                        logs = np.concatenate([logs[:base], np.zeros((base + 2 * len(fresh), len(names)))])
                    for i, k in enumerate(fresh.tolist()):
                        memo[listed[k]] = base + i
                    s, e = starts[first[fresh]], ends[first[fresh]]
                    for own in blocks(e - s):
                        lattice = Lattice(vocabulary, buf, s[own], e[own])
                        logs[base + own.start : base + own.stop] = lattice.sums(table)[lattice.last]
                    row = np.fromiter(map(memo.__getitem__, listed), np.int64, len(listed))
                    for k in range(len(names)):
                        total[:, k] = np.bincount(text, logs[row, k][inverse], len(chunk.texts))
                total += log_prior
                for line, raw in zip(total, chunk.texts, strict=True):
                    if names and has_letter(raw):
                        k = int(np.argmax(line))
                        pred.append(names[k])
                        score.append(float(1 / np.exp(line - line[k]).sum()))
                    else:
                        pred.append(UND)
                        score.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, training: DataFrame, path: str | None = None) -> DataFrame:
    """Learns from text and lang of ``training`` and identifies every row of ``docs``."""
    path = path or default_path("piece_bpe_32k.model")
    return identify(docs, *learn(training, F.col("lang"), path), path)
