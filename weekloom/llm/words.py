"""Counts of the lower-cased words of a corpus, by group."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.textops import Chunk, Hasher, chunks, ship, small, text_of

#: A word is a run of A-Z, a-z and bytes from 0x80 on, of any length.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of U+00C0 to U+00DE made small, in UTF-8."""
    out = _LOWER[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    at = at[(buf[at] >= 0x80) & (buf[at] <= 0x9E) & (buf[at] != 0x97)]
    out[at] += 32
    return out


def letter_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes; starts, ends and text of each word."""
    starts, ends, text = chunk.runs(LETTERS)
    return lowered(chunk.buf), starts, ends, text


def word_counts(docs: DataFrame, group: Column, most: int = 300_000, most_bytes: int = 16 << 20) -> DataFrame:
    """grp string, word binary, n long over all texts of each non-null group.

    Each task counts before the shuffle and lets go of its counts whenever it holds ``most`` words or ``most_bytes`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            grp = [g for g, c in held.items() for _ in range(len(c))]
            words = [w for c in held.values() for w in c]
            n = [x for c in held.values() for x in c.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(grp, pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["grp", "word", "n"])

        for batch in small(batches):
            groups = batch.column(0).to_pylist()
            for chunk in chunks(text_of(batch), 4 << 20):
                buf, starts, ends, text = letter_words(chunk)
                if not len(starts):
                    continue
                hashes, data = Hasher(buf)(starts, ends), buf.tobytes()
                names = groups[chunk.lo : chunk.hi]
                code = {g: i for i, g in enumerate(dict.fromkeys(names))}
                kind = np.array([code[g] for g in names])[text]
                for g, i in code.items():
                    own = np.flatnonzero(kind == i)
                    _, first, n = np.unique(hashes[own], return_index=True, return_counts=True)
                    counter = held.setdefault(g, Counter())
                    for a, b, k in zip(starts[own[first]].tolist(), ends[own[first]].tolist(), n.tolist(), strict=True):
                        counter[data[a:b]] += k
                    size += int((ends - starts)[own[first]].sum())
                if size > most_bytes or sum(map(len, held.values())) > most:
                    yield flush()
                    size = 0
        yield flush()

    ship(docs.sparkSession)
    rows = docs.select(group.cast("string").alias("grp"), "text").where("grp IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "grp string, word binary, n long").groupBy("grp", "word").agg(F.sum("n").alias("n"))
