"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence and density of words and word beginnings (by 64-bit hash), trained in numpy from texts confirmed toxic (P)
and unlabelled texts (U) by the class-prior-corrected risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

with the logistic loss; where the second term falls below zero, its gradient is reversed, so that
the classifier can't fit U by pushing all of it away.  The prior is the share of toxic ones among all labelled
training rows.  P and U are bounded samples (``most_p``, ``most_u``: the documents of smallest hashed id), whose features
are counted and gathered in Spark.  Only features whose shares in P and U differ by ``least_z`` standard errors and
by a factor of ``least_lift`` are used; every document is then scored in full.

A null or empty text has the score of the bias alone.  Several labels of a doc_id count as the most toxic one; rows that repeat a doc_id
are scored each, and learnt from if the sample holds it.  Columns of docs named score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.textops import Chunk, Hasher, Scratch, chunks, mix, ship, small, stride, text_of
from weekloom.llm.words import letter_words

BINS = 1 << 20
BEGINNINGS = (4, 5, 6)


class Features:
    """A set of features to look for: a table of bins, and (unless None) the sorted exact keys."""

    def __init__(self, bins: np.ndarray | None, keys: np.ndarray | None):
        self.bins, self.keys = bins, keys

    @classmethod
    def of(cls, keys: np.ndarray) -> Features:
        bins = np.zeros(BINS, bool)
        bins[keys % np.uint64(BINS)] = True
        return cls(bins, keys)

    def __call__(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, density), each pair once: the words and word beginnings of each text.  A feature is its key, or its place among the exact keys."""
        buf, starts, ends, text = letter_words(chunk)
        words = np.bincount(text, minlength=len(chunk.texts))
        hasher, of, found = Hasher(buf), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for k in (0, *BEGINNINGS):
            own = np.flatnonzero(ends - starts >= k)
            keys = hasher(starts[own], starts[own] + k if k else ends[own]) + stride(k)
            if self.bins is not None:
                some = self.bins[keys % np.uint64(BINS)]
                own, keys = own[some], keys[some]
            if self.keys is not None:
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                same = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
                own, keys = own[same], at[same].astype(np.uint64)
            of.append(text[own])
            found.append(keys)
        text, keys = np.concatenate(of), np.concatenate(found)
        _, first, count = np.unique(mix(keys + mix(text.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
        order = np.argsort(text[first], kind="stable")
        first, count = first[order], count[order]
        return text[first], keys[first], np.log1p(200 * count / (words[text[first]] + 50))


def bin_counts(sample: DataFrame) -> np.ndarray:
    """How many texts of either kind have a feature of each bin (a feature counts for each time it is met there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, every = np.zeros((2, BINS), np.int32), Features(None, None)
        for batch in small(batches):
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(text_of(batch)):
                text, keys, _ = every(chunk)
                np.add.at(count, (kind[chunk.lo : chunk.hi][text], (keys % np.uint64(BINS)).astype(np.int64)), 1)
        kind, place = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(place, pa.int64()), pa.array(count[kind, place].astype(np.int64))], ["kind", "bin", "n"])

    found = sample.mapInArrow(run, "kind long, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, BINS))
    out[found["kind"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
    return out


def feature_lists(sample: DataFrame, wanted: Features) -> DataFrame:
    """kind, and the wanted features and their densities, of each text of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(text_of(batch)):
                text, keys, density = wanted(chunk)
                cuts = np.searchsorted(text, np.arange(len(chunk.texts) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(kind[chunk.lo : chunk.hi], pa.int64()), *[pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (keys.view(np.int64), density)]], ["kind", "features", "densities"])

    return sample.mapInArrow(run, "kind long, features array<long>, densities array<double>")


def strong(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, least_z: float, least_lift: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether the shares of p in P and of u in U differ by enough standard errors and by a large enough factor; and the former number."""
    share = (p + u + 0.5) / (n_p + n_u + 1)
    z = np.abs(p / n_p - u / n_u) / np.sqrt(share * np.maximum(1 - share, 1e-9) * (1 / n_p + 1 / n_u))
    lift = (p + 0.5) / n_p / ((u + 0.5) / n_u)
    return (z >= least_z) & (np.maximum(lift, 1 / lift) >= least_lift), z


def gather(docs: DataFrame, labels: DataFrame, usable: Column, most_p: int, most_u: int) -> tuple[DataFrame, float]:
    """The sample: kind (1 for P, 0 for U) and text; and the class prior."""
    labelled = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("sample_id")).agg(F.max("toxic").alias("toxic"))
    labelled = labelled.withColumnRenamed("sample_id", "doc_id").where(usable)
    n, toxic = labelled.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()

    def first(rows: DataFrame, most: int) -> DataFrame:
        """Those of the ``most`` smallest hashes.  All but about 1.5 times as many are filtered out by a cutoff before any are sorted."""
        share = 1.5 * most / max(rows.count(), 1)
        few = rows if share >= 1 else rows.where(F.xxhash64("doc_id") < int((share - 0.5) * 2.0**64))
        return few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    p = first(labelled.where("toxic > 0").select("doc_id"), most_p).withColumn("kind", F.lit(1))
    u = first(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(usable & F.col("doc_id").isNotNull()).distinct(), most_u).withColumn("kind", F.lit(0))
    ids = p.unionByName(u).withColumnRenamed("doc_id", "sample_id")
    # at most most_p + most_u ids of 12 bytes
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("sample_id")).select("kind", "text"), (toxic + 0.5) / (n + 1)


def nnpu(kind: np.ndarray, rows: list[np.ndarray], densities: list[np.ndarray], size: int, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights by Adam over all rows at once: of the presence of features 0 to size - 1, of their densities, and the bias as the last."""
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    column, value = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*densities, np.zeros(0)])
    row, column, value = np.tile(row, 2), np.append(column, column + size), np.append(np.ones(len(value)), value)
    size *= 2
    weight, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    weight[-1] = np.log(prior / (1 - prior))
    positive, unlabelled = kind == 1, kind == 0
    n_p, n_u = max(positive.sum(), 1), max(unlabelled.sum(), 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weight[column] * value, len(rows)) + weight[-1]
        up = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # derivative of the loss for -1; that for +1 is up - 1
        loss = np.logaddexp(0, z)
        rest = loss[unlabelled].sum() / n_u - prior * loss[positive].sum() / n_p
        slope = np.where(unlabelled, up / n_u, -prior * up / n_p)
        slope = -slope if rest < 0 else slope + np.where(positive, prior * (up - 1) / n_p, 0)
        grad = np.append(np.bincount(column, slope[row] * value, size), slope.sum())
        grad[:-1] += decay * weight[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weight -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return weight


def learn(docs: DataFrame, labels: DataFrame, usable: Column, most_p: int = 4000, most_u: int = 12_000, least_z: float = 4.0, least_lift: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the features, and weights with the bias last.  A feature has to occur at least four times in the sample.  Only rows where ``usable`` (an expression of doc_id) holds are learnt from."""
    scratch = Scratch(docs.sparkSession)
    rows, prior = gather(docs, labels, usable, most_p, most_u)
    sample = scratch.put(rows.select(F.col("kind").cast("long"), "text"))
    total = {x["kind"]: x["count"] for x in sample.groupBy("kind").count().collect()}
    n_p, n_u = max(total.get(1, 0), 1), max(total.get(0, 0), 1)
    # bins hold several features each, so the test on them is a looser one; the exact features are then tested alone
    count = bin_counts(sample)
    bins, _ = strong(count[1], count[0], n_p, n_u, least_z / 2, 1.1)
    listed = feature_lists(sample, Features(bins, None)).select("kind", F.explode("features").alias("feature"))
    exact = listed.groupBy("feature").agg(F.count_if(F.col("kind") == 1).alias("p"), F.count_if(F.col("kind") == 0).alias("u")).where(F.col("p") + F.col("u") >= 4).toArrow()
    good, _ = strong(exact["p"].to_numpy(), exact["u"].to_numpy(), n_p, n_u, least_z, least_lift)
    keys = np.sort(exact["feature"].to_numpy().astype(np.int64)[good].view(np.uint64))
    held = feature_lists(sample, Features.of(keys)).toArrow()
    weight = nnpu(held["kind"].to_numpy(), [np.array(x, np.int64) for x in held["features"].to_pylist()], [np.array(x, float) for x in held["densities"].to_pylist()], len(keys), prior)
    scratch.drop(sample)
    return keys, weight


def scored(docs: DataFrame, keys: np.ndarray, weight: np.ndarray) -> DataFrame:
    """All columns of docs (but own ones named score or predicted), score and predicted."""
    held = ship(docs.sparkSession).sparkContext.broadcast((keys, weight))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        keys, weight = held.value
        wanted, out = Features.of(keys), [np.zeros(0)]
        for chunk in chunks(texts):
            text, feature, density = wanted(chunk)
            feature = feature.astype(np.int64)
            z = np.bincount(text, weight[feature] + weight[feature + len(keys)] * density, len(chunk.texts)) + weight[-1]
            out.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
        return pa.array(np.concatenate(out))

    rows = docs.drop("score", "predicted")
    return rows.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column, training: DataFrame | None = None, **bounds: int) -> DataFrame:
    """Learns from ``training`` (default: docs) and ``labels`` and scores every row of ``docs``."""
    return scored(docs, *learn(docs if training is None else training, labels, usable, **bounds))
