"""Finding licence texts and notices in documents by a generalised suffix automaton of their words.

The automaton holds all substrings of all templates, as word numbers.  A document's words are streamed through it, which gives *matching
statistics*: at each word, the longest run ending there that some template has, and the state that stands for it.  Runs that can't be
prolonged are anchors; anchors of one template that lie in order, with small gaps, are chained into spans, and a span's share of
the template's words decides whether the template's label is given.  Short *phrases* are templates too, of which every place counts.

A run of two or more words consists of pairs that a template has, so words outside such pairs are passed over with arrays, and only
the rest goes through the automaton.  The templates are a parameter of some kilobytes, and each task builds the automaton from them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weekloom.llm.textops import Chunk, Hasher, chunks, ship, small, text_of

#: A word is a run of these bytes once A-Z are made small: digits, a-z and all from 0x80 on.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Automaton:
    """Generalised suffix automaton of sequences of numbers, built online, one sequence after the other."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # sequence and end of the prefixes that a state is the longest name of
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].append((k, at + 1))
        self.occurrences = [list(x) for x in self.ends]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state]:
                self.occurrences[self.link[state]] += self.occurrences[state]

    def _state(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of p's longest string and the word, taken out of q if q stands for longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.next[last][word])
        return new

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


def chained(anchors: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """First word, last word and covered words of disjoint chains of anchors (end in the document, end in the template, length).

    A chain goes forward in both, with at most ``gap`` words between anchors in either.  The chain that covers most comes first, then the earlier one; others
    are taken while they overlap none of those taken.
    """
    anchors = sorted(anchors)
    best: list[int] = []
    first: list[int] = []
    ends = [x[0] for x in anchors]
    for j, (end, place, length) in enumerate(anchors):
        covered, start = length, end - length
        for p in range(bisect.bisect_left(ends, end - length - gap), j):
            before, there, _ = anchors[p]
            if before < end and place - length - gap <= there < place:
                total = best[p] + min(length, end - before, place - there)
                if total > covered or (total == covered and first[p] < start):
                    covered, start = total, first[p]
        best.append(covered)
        first.append(start)
    taken: list[tuple[int, int, int]] = []
    for covered, start, end in sorted(zip(best, first, ends, strict=True), key=lambda x: (-x[0], x[1], x[2])):
        i = bisect.bisect_left(taken, (start, 0, 0))
        if (i == 0 or taken[i - 1][1] < start) and (i == len(taken) or end <= taken[i][0]):
            taken.insert(i, (start, end - 1, covered))
    return taken


class Scanner:
    """Templates and phrases in one automaton, and the words of a text brought to its numbers."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], least: int, gap: int):
        self.least, self.gap = least, gap
        self.labels = [label for _, label in (*phrases, *templates)]
        self.n_phrases = len(phrases)
        texts = [text.encode() for text, _ in (*phrases, *templates)]
        number: dict[bytes, int] = {}
        sequences = []
        for text in texts:
            chunk = Chunk(0, [text])
            buf = _LOWER[chunk.buf].tobytes()
            sequences.append([number.setdefault(buf[a:b], len(number)) for a, b in zip(*(x.tolist() for x in chunk.runs(_WORD)[:2]), strict=True)])
        if any(len(x) < 2 for x in sequences) or any(len(x) < least for x in sequences[self.n_phrases :]):
            raise ValueError("phrases have two words at least, templates also as many as an anchor")
        self.sizes = list(map(len, sequences))
        self.automaton = Automaton(sequences)
        packed = np.frombuffer(b"".join(number) + b"\n", np.uint8)
        stop = np.cumsum(list(map(len, number)))
        hashes = Hasher(packed)(np.r_[0, stop[:-1]], stop)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.widths = np.diff(np.r_[0, stop])[order]
        pairs = {x << 32 | y for s in sequences for x, y in zip(s, s[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        #: States on whose path to the root a phrase's own state lies: the phrase and its length.
        self.whole: dict[int, list[tuple[int, int]]] = {}
        state_of = {}
        for k in range(self.n_phrases):
            state = 0
            for word in sequences[k]:
                state = self.automaton.next[state][word]
            state_of.setdefault(state, []).append((k, self.sizes[k]))
        for state in range(1, len(self.automaton.link)):
            at, found = state, []
            while at > 0:
                found += state_of.get(at, [])
                at = self.automaton.link[at]
            if found:
                self.whole[state] = found

    def numbered(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word (-1: in no template) and its text."""
        starts, ends, text = chunk.runs(_WORD)
        if not len(starts):
            return np.zeros(0, np.int64), text
        hashes = Hasher(_LOWER[chunk.buf])(starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.widths[at] == ends - starts), self.numbers[at], -1), text

    def runs(self, words: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
        """First and last (excluded) word of the longest runs of which each two neighbours are a pair of some template."""
        if len(words) < 2:
            return []
        near = (words[:-1] >= 0) & (words[1:] >= 0) & (text[:-1] == text[1:])
        at = np.flatnonzero(near)
        near[at] = np.isin(words[at] << 32 | words[at + 1], self.pairs)
        edges = np.flatnonzero(np.diff(np.r_[False, near, False].astype(np.int8)))
        return [(lo, hi + 1) for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]

    def matches(self, words: list[int], begin: int, phrases: list[tuple[int, int]], anchors: dict[int, list[tuple[int, int, int]]]) -> None:
        """Adds the places of phrases, and for each template the anchors that can't be prolonged; places count from ``begin``."""
        a = self.automaton
        held: dict[tuple[int, int], int] = {}

        def let_go(kept: dict) -> None:
            for (k, place), length in held.items():
                if (k, place + 1) not in kept:
                    anchors.setdefault(k, []).append((begin + at, place, length))

        for at, (state, length) in enumerate(a.statistics(words)):
            phrases += [(k, begin + at + 1 - size) for k, size in self.whole.get(state, ()) if size <= length]
            now: dict[tuple[int, int], int] = {}
            if length >= self.least:
                here, reach = state, length
                while here > 0 and reach >= self.least:
                    for k, place in a.occurrences[here]:
                        if k >= self.n_phrases:
                            now.setdefault((k, place), reach)
                    here = a.link[here]
                    reach = a.length[here]
            let_go(now)
            held = now
        at = len(words)
        let_go({})

    def scan(self, words: np.ndarray, text: np.ndarray, n_texts: int) -> list[tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]]:
        """Of each text: places of phrases (phrase, first word), and spans (template, first word, last word, covered words)."""
        begins = np.searchsorted(text, np.arange(n_texts))
        found: list = [([], {}) for _ in range(n_texts)]
        for lo, hi in self.runs(words, text):
            t = int(text[lo])
            self.matches(words[lo:hi].tolist(), lo - int(begins[t]), *found[t])
        return [(phrases, [(k, *span) for k, own in sorted(anchors.items()) for span in chained(own, self.gap)]) for phrases, anchors in found]


@lru_cache(4)
def scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], least: int, gap: int) -> Scanner:
    return Scanner(templates, phrases, least, gap)


def licence_scan(docs: DataFrame, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], least: int = 3, gap: int = 8, share: float = 0.7) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are left): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``templates`` and ``phrases`` are pairs of text and label.  ``n_base`` counts all places of phrases, overlapping ones too; first_word and last_word are the least and the greatest word at which one starts.
    ``spans`` holds label, template, first_word, last_word, covered and share of every chain that covers at least ``share`` of its template; anchors have at least ``least`` words, and
    chains pass over at most ``gap`` words.  ``labels`` are those of phrases and spans; ``score`` is the largest share that any chain covers, 1 where a phrase occurs, and 0 without either.

    A null or empty text has no words, no labels ('') and score 0; among equally good chains the earliest counts; rows that repeat get the same result each.
    """
    templates, phrases = tuple(map(tuple, templates)), tuple(map(tuple, phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = scanner(templates, phrases, least, gap)
        first = held.n_phrases
        kinds = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))
        for batch in small(batches):
            rows: list[tuple] = []
            for chunk in chunks(text_of(batch)):
                words, text = held.numbered(chunk)
                n_words = np.bincount(text, minlength=len(chunk.texts)).tolist()
                for n, (places, chains) in zip(n_words, held.scan(words, text, len(chunk.texts)), strict=True):
                    starts = [at for _, at in places]
                    base = {held.labels[k] for k, _ in places}
                    parts = [(k, lo, hi, covered, covered / held.sizes[k]) for k, lo, hi, covered in chains]
                    spans = [{"label": held.labels[k], "template": k - first, "first_word": lo, "last_word": hi, "covered": covered, "share": part} for k, lo, hi, covered, part in parts if part >= share]
                    labels = base | {x["label"] for x in spans}
                    score = 1.0 if places else max((x[-1] for x in parts), default=0.0)
                    rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans))
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names)

    ship(docs.sparkSession)
    id_type = docs.select("doc_id").schema[0].dataType.simpleString()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = "struct<label: string, template: int, first_word: long, last_word: long, covered: long, share: double>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{span}>")
