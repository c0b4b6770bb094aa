"""Line dedup over levelled, sorted runs of line hashes.

A run is a table with one row per line key (16 bytes of MD5), bucketed and sorted by key: in how many documents of its batches it
was found, the largest of them, and the rows whose lines wait for a verdict.  Batches come in descending doc_id, so
the document in which a key is seen first is the one that keeps its lines.

*A batch* is merge-joined with all runs, bucket by bucket; only its own keys are shuffled.  A key that now has ``min_docs`` documents is
settled: its lines in the batch go, and so do those that waited.  The batch's own run is the anti-join of its keys with
the settled ones: new keys, and further documents of keys that still wait.  As soon as a level has ``fanout`` runs they are
merged, equal buckets with equal buckets, into one of the next level, so that the number of runs stays logarithmic in the batches.

*Frequent keys.*  Keys that a sketch finds in a large share of a batch's rows (at most ``FREQUENT`` of them) are judged apart: their verdicts
are broadcast to their rows, so that no task gets all rows of one key.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased; keys of fewer than ``min_chars``
code points always stay.  A null or empty text is one empty line.  Rows that repeat a doc_id are one document when documents are
counted, and each loses its own lines; a row with a null doc_id counts for nothing and is left as it is.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.llm.textops import Scratch, column, frequent, ship, small, text_of, unused

BLANKS = b" \t\n\x0b\x0c\r"
FREQUENT = 200
_ROWS = "array<struct<doc_id: bigint, row: bigint, lines: array<int>>>"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(BLANKS)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.md5(key.lower(), usedforsecurity=False).digest()


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row (a hash of the text), key, lines: each key of a row once, with the numbers of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list = [[], [], [], []]
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_of(batch).cast(pa.large_binary()), strict=True):
                found = defaultdict(list)
                for k, line in enumerate(text.as_py().split(b"\n")):
                    if (key := line_key(line, min_chars)) is not None:
                        found[key].append(k)
                for c, values in zip(out, ([doc] * len(found), [row] * len(found), found.keys(), found.values()), strict=True):
                    c.extend(values)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "row", "key", "lines"])

    ship(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_hash(docs).alias("row"), docs["text"].alias("text"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "doc_id long, row long, key binary, lines array<int>")


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"])


class LineRuns:
    """The levels, each a list of bucketed, sorted runs in the shared scratch folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3, min_chars: int = 20, min_docs: int = 3, buckets: int | None = None):
        self.spark, self.scratch, self.fanout, self.min_chars, self.min_docs = spark, Scratch(spark), fanout, min_chars, max(min_docs, 2)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.gone: list[DataFrame] = []
        self.floor: int | None = None

    def store(self, run: DataFrame) -> DataFrame:
        """A run, written as a table that is bucketed and sorted by key."""
        name, path = f"line_run_{uuid.uuid4().hex}", f"{self.scratch.root}/run-{uuid.uuid4().hex}"
        run.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        held = self.spark.table(name)
        held.scratch_path, held.table_name = path, name
        return held

    def discard(self, runs: list[DataFrame]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE {run.table_name}")
        self.scratch.drop(*runs)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def merged(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Two sorted runs as one."""
        both = left.alias("a").join(right.alias("b").hint("merge"), F.col("a.key") == F.col("b.key"), "full")
        n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        none = F.array().cast(_ROWS)
        waiting = F.when(n < self.min_docs, F.concat(F.coalesce("a.waiting", none), F.coalesce("b.waiting", none))).otherwise(none)
        return both.select(F.coalesce("a.key", "b.key").alias("key"), F.least(n, F.lit(self.min_docs)).alias("n"), F.greatest("a.last_doc", "b.last_doc").alias("last_doc"), waiting.alias("waiting"))

    def known(self, rows: DataFrame) -> DataFrame:
        """Adds what the runs know of each row's key: known, keeper (the largest document), waited (rows that wait)."""
        out = rows.withColumns({"known": F.lit(0), "keeper": F.lit(None).cast("long"), "waited": F.array().cast(_ROWS)})
        for run in self.runs():
            r = run.alias("r")
            out = out.alias("o").join(r.hint("merge"), F.col("o.key") == F.col("r.key"), "left").select(
                *[F.col(f"o.{c}") for c in rows.columns], (F.col("o.known") + F.coalesce("r.n", F.lit(0))).alias("known"),
                F.greatest("o.keeper", "r.last_doc").alias("keeper"), F.concat("o.waited", F.coalesce("r.waiting", F.array().cast(_ROWS))).alias("waited"),
            )
        return out

    def frequent_keys(self, rows: DataFrame, total: int) -> DataFrame | None:
        """key, last_b: keys with a large share of the rows and at least ``min_docs`` documents."""
        tags = frequent(rows, F.col("key"), FREQUENT) if total > 1000 else []
        if not tags:
            return None
        counted = rows.where(F.xxhash64("key").isin(tags)).groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last_b"))
        return self.scratch.put(counted.where(F.col("n") >= self.min_docs).select("key", "last_b"))

    def add(self, batch: DataFrame) -> None:
        """Documents of one batch; every doc_id is smaller than those of the batches before."""
        rows = self.scratch.put(line_keys(batch, self.min_chars))
        total, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
        if not total:
            return
        if self.floor is not None and high >= self.floor:
            raise ValueError(f"batches come in descending doc_id: {high} is not below {self.floor}")
        self.floor = low
        heavy = self.frequent_keys(rows, total)
        rest = rows if heavy is None else rows.join(F.broadcast(heavy), "key", "left_anti")  # at most FREQUENT keys
        by_key = Window.partitionBy("key")
        place = F.dense_rank().over(by_key.orderBy(F.desc("doc_id")))
        ranked = rest.repartition(self.buckets, "key").withColumn("place", place)
        ranked = ranked.withColumns({"n_b": F.max("place").over(by_key), "last_b": F.max("doc_id").over(by_key)})
        judged = self.scratch.put(self.known(ranked).withColumns({"n": F.col("known") + F.col("n_b"), "keeper": F.coalesce("keeper", "last_b")}))
        settled, before = F.col("n") >= self.min_docs, F.col("known") >= self.min_docs
        fields = ("doc_id", "row", "lines")
        waited = lambda frame: frame.select(F.explode("waited").alias("w")).select(*[F.col(f"w.{c}").alias(c) for c in fields])
        gone = judged.where(settled & (F.col("doc_id") != F.col("keeper"))).select(*fields)
        gone = gone.unionByName(waited(judged.where(settled & ~before & (F.col("doc_id") == F.col("last_b")))))
        # further documents of a key that is not settled wait, all but the one that keeps its lines
        waits = F.when(~settled & (F.col("doc_id") != F.col("keeper")), F.struct(*fields))
        own = judged.where(~before & (F.col("place") < self.min_docs)).groupBy("key").agg(
            F.max(F.least("n_b", F.lit(self.min_docs))).alias("n"), F.max("last_b").alias("last_doc"), F.collect_list(waits).alias("waiting")
        )
        if heavy is not None:
            verdict = self.scratch.put(self.known(heavy.repartition(self.buckets, "key")).withColumn("keeper", F.coalesce("keeper", "last_b")))
            gone = gone.unionByName(rows.join(F.broadcast(verdict.select("key", "keeper")), "key").where("doc_id <> keeper").select(*fields))
            gone = gone.unionByName(waited(verdict.where(F.col("known") < self.min_docs)))
            fresh = verdict.where(F.col("known") < self.min_docs)
            own = own.unionByName(fresh.select("key", F.lit(self.min_docs).alias("n"), F.col("last_b").alias("last_doc"), F.array().cast(_ROWS).alias("waiting")))
        self.gone.append(self.scratch.put(gone))
        self.levels[0].append(self.store(own))
        self.scratch.drop(rows, judged)
        self.compact()

    def compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(self.store(reduce(self.merged, old)))
            self.discard(old)

    def clean(self, docs: DataFrame) -> DataFrame:
        """All columns of docs, text cleaned, with n_lines and n_dropped (columns of docs with these names are replaced)."""
        own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        lines, row, doc = unused(docs, "lines", "row", "gone_doc")
        gone = self.gone or [self.spark.createDataFrame([], "doc_id long, row long, lines array<int>")]
        every = reduce(DataFrame.unionByName, gone).groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.flatten(F.collect_list("lines")).alias(lines))
        joined = docs.join(every, (docs["doc_id"].cast("long") == every[doc]) & (row_hash(docs) == every[row]), "left")

        @F.arrow_udf("binary")
        def cleaned(texts: pa.Array, dropped: pa.Array) -> pa.Array:
            kept = []
            for text, drop in zip(texts.cast(pa.large_binary()), dropped, strict=True):
                body = text.as_py() or b""
                if drop.is_valid:
                    lost = set(drop.as_py())
                    body = b"\n".join(x for k, x in enumerate(body.split(b"\n")) if k not in lost)
                kept.append(body)
            return pa.array(kept, pa.binary())

        # a line feed is one byte, so lines are counted without the texts' leaving the JVM
        n = F.length("text") - F.length(F.replace(docs["text"], F.lit("\n"), F.lit(""))) + 1
        text = F.when(every[lines].isNull(), F.coalesce(docs["text"], F.lit(""))).otherwise(cleaned(docs["text"], every[lines]).cast("string"))
        counts = [F.coalesce(n, F.lit(1)).cast("long").alias("n_lines"), F.coalesce(F.size(F.array_distinct(every[lines])), F.lit(0)).cast("long").alias("n_dropped")]
        return joined.select(*[text.alias(c) if c == "text" else column(docs, c) for c in own], *counts)


def line_dedup(docs: DataFrame, batches: int = 4, fanout: int = 3, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Cleans a whole table: it is cut at approximate quantiles of doc_id into at most ``batches`` parts, which come from the largest doc_id down."""
    runs = LineRuns(docs.sparkSession, fanout, min_chars, min_docs)
    number = docs["doc_id"].cast("long")
    cuts = docs.agg(F.percentile_approx(number, [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    edges = [None, *sorted(set(cuts or ())), None]
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        part = docs if low is None else docs.where(number > low)
        runs.add(part if high is None else part.where(number <= high))
    runs.discard(runs.runs())
    return runs.clean(docs)
