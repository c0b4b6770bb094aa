"""Numpy helpers over Arrow batches of texts, and scratch tables on shared storage.

Texts are handled as UTF-8 bytes.  Several texts are laid end to end, with a line feed after each,
and cut into chunks of a bounded size, so that the temporary arrays stay small whatever the batch holds.
A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``; as these bytes never occur inside a
multi-byte character, this equals splitting the characters.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1000
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_PRIME, _BITS = np.uint64((1 << 31) - 1), np.uint64(31)
_BASES = (1_183_640_369, 1_907_561_021)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stride(k: int) -> np.uint64:
    """The k-th of a sequence of well spread 64-bit numbers."""
    return np.uint64(k * _BASE & (1 << 64) - 1)


#: A pseudo-random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _fold(x: np.ndarray) -> np.ndarray:
    """The remainder of numbers below 2**63 by the prime 2**31 - 1."""
    x = (x & _PRIME) + (x >> _BITS)
    x = (x & _PRIME) + (x >> _BITS)
    return x - _PRIME * (x >= _PRIME)


def _power(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, from 0 to n at least.  Those for chunks of the usual sizes are kept, longer tables are not."""
    if not _powers or len(_powers[0][0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1024)
        found = []
        for base in _BASES:
            both = []
            for x in (base, pow(base, -1, int(_PRIME))):
                out = np.ones(size, np.uint64)
                have = 1
                while have < size:
                    more = min(have, size - have)
                    out[have : have + more] = _fold(out[:more] * np.uint64(pow(x, have, int(_PRIME))))
                    have += more
                both.append(out.astype(np.uint32))
            found.append(tuple(both))
        if size > 4 * CHUNK_BYTES + 1024:
            return found
        _powers[:] = found
    return _powers


class Hasher:
    """62-bit hashes, spread over 64 bits, of any substrings of ``buf``, each in constant time after one pass.

    They are polynomials modulo a prime at two fixed points.  (Modulo a power of two, texts as plain as those of Thue and Morse collide for every base.)
    """

    def __init__(self, buf: np.ndarray, values: np.ndarray = BYTE_VALUES):
        self.sums, self.down = [], []
        for k, (up, down) in enumerate(_power(len(buf) + 1)):
            letters = _fold(values >> np.uint64(1) if k else (values & _PRIME) + np.uint64(1))
            terms = letters[buf]
            terms *= up[: len(buf)]
            high = terms >> _BITS
            terms &= _PRIME
            terms += high  # below 2**33: sums of 2**30 terms stay below 2**63
            sums = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._joined(lambda sums, down: _fold(_fold(sums[ends] - sums[starts]) * down[starts]))

    def windows(self, length: int) -> np.ndarray:
        """Of every substring of this length, by its start."""
        n = max(len(self.sums[0]) - length, 0)
        return self._joined(lambda sums, down: _fold(_fold(sums[length:] - sums[:n]) * down[:n]))

    def _joined(self, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        out = part(self.sums[0], self.down[0])
        out <<= _BITS
        out |= part(self.sums[1], self.down[1])
        return mix(out)


class Chunk:
    """Some consecutive texts of a batch: rows lo to hi, their bytes, and where each begins and ends."""

    def __init__(self, lo: int, texts: list[bytes]):
        self.lo, self.hi, self.texts = lo, lo + len(texts), texts
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that the table ``inside`` has, and the text of each."""
        flag = np.zeros(len(self.buf) + 2, np.int8)
        flag[1:-1] = inside[self.buf]
        edges = np.flatnonzero(flag[1:] != flag[:-1])
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, np.searchsorted(self.ends, starts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~_SPACE)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column's texts in chunks of about ``most`` bytes (a longer text is a chunk of its own); null counts as empty."""
    held: list[bytes] = []
    size = lo = 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        text = value.as_py() or b""
        if held and size + len(text) > most:
            yield Chunk(lo, held)
            held, size, lo = [], 0, i
        held.append(text)
        size += len(text) + 1
    if held:
        yield Chunk(lo, held)


def shingles(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the text of each; a text of fewer words has one, of them all."""
    starts, ends, text = chunk.words()
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = Hasher(chunk.buf)(starts, ends)
    weights = mix(np.arange(11, 11 + width, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    n = max(len(words) - width + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += words[j : j + n] * weights[j]
    whole = text[:n] == text[width - 1 : width - 1 + n]
    found, of = [mix(total[whole])], [text[:n][whole]]
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.r_[first, len(text)])
    for k in range(1, width):
        at = first[count == k]
        if len(at):
            total = np.full(len(at), k, np.uint64)
            for j in range(k):
                total += words[at + j] * weights[j]
            found.append(mix(total))
            of.append(text[at])
    return np.concatenate(found), np.concatenate(of)


def bags(hashes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each group: hash, group, how often; in no particular order."""
    _, first, count = np.unique(mix(hashes + mix(group.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    return hashes[first], group[first], count


def text_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be no column's."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(frame: DataFrame, name: str) -> Column:
    """A column by its whole name, dots and all."""
    return frame["`" + name.replace("`", "``") + "`"]


def frequent(rows: DataFrame, key: Column, most: int = 200) -> list[int]:
    """Hashes (xxhash64) of the keys that a sketch finds in more than 1 / ``most`` of at least 1000 * ``most`` / 200 rows; at most ``most`` of them."""
    found = rows.select(F.xxhash64(key).alias("tag")).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(tag, {most}, {50 * most})").alias("top")).first()
    return [x[0] for x in found["top"] or () if x[1] > max(1000, found["n"] // most)]


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins rows with a table of distinct keys.  Keys with a large share of the rows are joined by broadcast (at most 200 of the table's rows), so no task gets all their rows.

    Both sides are read more than once, so they should be written tables.
    """
    tags = frequent(rows, F.col(key))
    if not tags:
        return rows.join(table.hint("merge"), key, how)
    hot = F.xxhash64(key).isin(tags)
    return rows.where(hot).join(F.broadcast(table.where(hot)), key, how).unionByName(rows.where(~hot | F.col(key).isNull()).join(table.where(~hot).hint("merge"), key, how))


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that what is worked on at once stays small; Spark itself bounds a batch by rows and bytes.  At the end of a task its memory goes back."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(lo, BATCH_ROWS)
    release()


def release() -> None:
    """Gives memory that was freed back to the system, as a worker that has done one heavy group lives on through other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


class Scratch:
    """Tables written to the shared folder named in ``spark.checkpoint.dir``, to cut lineage.

    Where a session on one machine (a local master) has no such setting, a temporary folder takes its place; a cluster must have it.
    """

    _own = ""

    def __init__(self, spark: SparkSession):
        self.spark = ship(spark)
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            Scratch._own = root = Scratch._own or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        self.root = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        self.count = 0

    def put(self, frame: DataFrame, sort: list[str] | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        (frame.sortWithinPartitions(*sort) if sort else frame).write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out.scratch_path = path
        return out

    def ids(self, frame: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
        """One column of distinct ids, written; marked for broadcast only if their counted number of 16 bytes each fits ``most_bytes``."""
        held = self.put(frame.distinct())
        return F.broadcast(held) if 16 * held.count() <= most_bytes else held

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing still to run reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
            path.getFileSystem(conf).delete(path, True)
