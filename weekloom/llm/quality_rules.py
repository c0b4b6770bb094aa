"""Quality rules whose cutoffs are certified on labelled holdouts.

For each stratum (language), the labelled documents are dealt by a hash into two halves.  On the first, a
sequence of ever stricter rule sets is drawn up: step by step one rule's cutoff is lowered.  On the
second, the holdout, the steps are tested in that order: step k passes if the exact binomial test at
level ``delta / strata`` rejects "more than ``alpha`` of the good documents are refused", which is the same as
the Clopper-Pearson upper bound lying below ``alpha``.  Testing stops at the first step that does not pass
(a fixed sequence needs no further correction), and Bonferroni's division covers the strata: with
probability ``1 - delta`` no stratum refuses more than ``alpha`` of its good documents.  A stratum with too
few labels to certify anything refuses nothing beyond the base rules.

Only counts by stratum, rule and hundredth come to the driver; they are as many at every input size.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.textops import Chunk, Hasher, Scratch, bags, chunks, mix, ship, small, text_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_upper", "n_letters", "n_marks"]
#: A rule refuses a document whose value, in whole hundredths of the range, reaches the cutoff.
RULES = {
    "symbols": "100.0 * n_symbols / n_words",
    "duplicate_lines": "100.0 * n_dup_lines / n_word_lines",
    "repeated_words": "100.0 * n_repeat_words / n_words",
    "capitals": "100.0 * n_upper / n_letters",
    "marks": "100.0 * n_marks / n_words",
    "long_words": "4.0 * word_chars / n_words",
    "short_words": "100 - 12.0 * word_chars / n_words",
}
TOP = 100
#: Shares of good documents that a step may refuse on the first half.
LEVELS = (0.0, 0.002, 0.005, 0.01, 0.02)


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_SYMBOL = _table(b"#*$%&|<>")
_MARK = _table(b"!?")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))


def counted(chunk: Chunk, window: int = 8) -> np.ndarray:
    """COUNTS of each text, a row each."""
    buf, n = chunk.buf, len(chunk.texts)
    starts, ends, text = chunk.words()
    hasher = Hasher(buf)
    word = hasher(starts, ends)
    out = np.zeros((n, len(COUNTS)), np.int64)

    def total(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flag)))
        return sums[chunk.ends] - sums[chunk.starts]

    out[:, 0] = np.bincount(text, minlength=n)
    space = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
    out[:, 1] = total(~space[buf] & (buf & 0xC0 != 0x80))
    out[:, 2] = total(_SYMBOL[buf])
    out[:, 6], out[:, 7], out[:, 8] = total(_UPPER[buf]), total(_LETTER[buf]), total(_MARK[buf])

    line_ends = np.flatnonzero(buf == 10)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1))
    solid = np.concatenate(([0], np.cumsum(~space[buf])))
    some = solid[line_ends] > solid[line_starts]
    line_starts, line_ends = line_starts[some], line_ends[some]
    line_text = np.searchsorted(chunk.ends, line_starts)
    out[:, 5] = np.bincount(line_text, minlength=n)
    _, of, times = bags(hasher(line_starts, line_ends), line_text)
    out[:, 3] = np.bincount(of, weights=times - 1, minlength=n)

    m = len(word) - window + 1
    if m > 0:
        sums = np.zeros(m, np.uint64)
        for j in range(window):
            sums += word[j : j + m] * (mix(np.array([j + 77], np.uint64)) | np.uint64(1))
        at = np.flatnonzero(text[:m] == text[window - 1 :])
        keys = mix(mix(sums[at]) + mix(text[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        same = np.concatenate(([False], keys[order][1:] == keys[order][:-1], [False]))
        at = at[order[same[1:] | same[:-1]]]
        change = np.zeros(len(word) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        out[:, 4] = np.bincount(text[np.cumsum(change[:-1]) > 0], minlength=n)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and COUNTS; a null text counts as empty, a null language is the stratum ``""``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [counted(c) for c in chunks(text_of(batch))]
            values = np.concatenate(found) if found else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, values.T)], ["doc_id", "stratum", *COUNTS])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), "text")
    return rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def with_base(measured: DataFrame) -> DataFrame:
    """Adds base_failed and a column for each rule, in hundredths."""
    base = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    rules = {name: F.expr(f"CAST(least({TOP}, greatest(0, floor(coalesce(try_divide({x.rpartition(' / ')[0]}, {x.rpartition(' / ')[2]}), 0)))) AS INT)") for name, x in RULES.items()}
    return measured.withColumns({"base_failed": base, **rules})


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial count."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    return min(1.0, math.fsum(map(math.exp, logs)))


def steps_of(good: dict[str, np.ndarray], bad: dict[str, np.ndarray]) -> list[dict[str, int]]:
    """Ever stricter cutoffs by rule, from counts of the first half by rule and hundredth."""
    tail = lambda x: np.cumsum(x[::-1])[::-1]
    now, out = dict.fromkeys(RULES, TOP + 1), []
    for level in LEVELS:
        for rule in RULES:
            g, b = tail(good[rule]), tail(bad[rule])
            if not g[0] or not b[0]:
                continue
            fits = np.flatnonzero((g <= level * g[0]) & (b > 0) & (b / b[0] >= 3 * g / g[0]))
            cut = max(int(fits[0]), 1) if len(fits) else TOP + 1
            if cut < now[rule]:
                now = now | {rule: cut}
                out.append(now)
    return out


def refused(cuts: dict[str, int]) -> F.Column:
    return F.greatest(*[(F.col(r) >= c).cast("int") for r, c in cuts.items()]) == 1


def certify(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> dict[str, dict[str, int]]:
    """The cutoffs of each stratum: those of the last step that passes.  A doc_id with several labels is good only if all say so."""
    marks = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("good"))
    rows = with_base(measured).where("NOT base_failed").join(marks, F.col("doc_id") == F.col("label_id"))
    rows = rows.select("stratum", (F.col("good") > 0).alias("good"), (F.crc32(F.col("doc_id").cast("string")) % 2 == 0).alias("first"), *RULES)
    held = rows.unpivot(["stratum", "good", "first"], list(RULES), "rule", "at").where("first").groupBy("stratum", "good", "rule", "at").count().collect()
    tables: dict = defaultdict(lambda: {g: {r: np.zeros(TOP + 1, np.int64) for r in RULES} for g in (True, False)})
    for x in held:
        tables[x["stratum"]][x["good"]][x["rule"]][x["at"]] = x["count"]
    enough = math.log(delta) / math.log1p(-alpha)  # fewer can't pass any test
    plans = {s: steps_of(t[True], t[False]) for s, t in tables.items() if sum(t[True]["marks"]) >= enough}
    plans = {s: p for s, p in plans.items() if p}
    if not plans:
        return {}
    step = F.lit(None).cast("int")
    for s, plan in plans.items():
        for k in reversed(range(len(plan))):
            step = F.coalesce(F.when((F.col("stratum") == s) & refused(plan[k]), F.lit(k)), step)
    seen: dict = defaultdict(lambda: [0, defaultdict(int)])
    for x in rows.where("good AND NOT first").groupBy("stratum", step.alias("step")).count().collect():
        seen[x["stratum"]][0] += x["count"]
        if x["step"] is not None:
            seen[x["stratum"]][1][x["step"]] += x["count"]
    chosen = {}
    for s, plan in plans.items():
        n, by_step = seen[s]
        out = 0
        for k, cuts in enumerate(plan):
            out += by_step[k]
            if binomial_tail(out, n, alpha) > delta / len(plans):
                break
            chosen[s] = cuts
    return chosen


def quality(docs: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """doc_id, stratum, COUNTS, a column per rule, base_failed, refused_by (the rules that refuse it) and kept; a row per document."""
    measured = Scratch(docs.sparkSession).put(measure(docs))
    cuts = certify(measured, labels, alpha, delta)
    verdict = F.array().cast("array<string>")
    for s, own in cuts.items():
        rules = F.filter(F.array(*[F.when(F.col(r) >= c, F.lit(r)) for r, c in own.items()]), lambda x: x.isNotNull())
        verdict = F.when(F.col("stratum") == s, rules).otherwise(verdict)
    return with_base(measured).withColumn("refused_by", verdict).withColumn("kept", F.expr("NOT base_failed AND size(refused_by) = 0"))
