"""URL filters: rules, then naive Bayes over the words of host and path.

Names of hosts are often several words run together.  A unigram Viterbi search cuts each run of letters or digits of a host into
the words of the corpus, maximising the sum of log probabilities; an unknown character costs a fixed amount, so every
name has a cut.  A multinomial naive Bayes classifier over the words of host and path then judges the urls that no rule fits.
It learns from the urls that a rule does fit, with the rule's verdict as their label: from all of them, or from
about ``most_training`` chosen by a hash of the url where there are more.

*Dictionary.*  Every word of the corpus counts, with its count over all texts: each distinct name's substrings are joined with the table
of counts, so neither the driver nor a task holds a dictionary.  Substrings are of 2 to 63 characters, as a part
of a host's name has at most 63; longer names (which no real host has) are cut with the same words, in windows.  The words of a name are joined back to hosts, and those of a host to its urls; names and
hosts with a large share of the rows are joined by broadcast.

A rule is (verdict, host, path prefix): it fits its host and all subdomains if the path begins
with its path; the longest fitting rule wins (by host and path together, then by the rule's text).
A null url, or one without ``://``, has an empty host and path.  Unless both verdicts are learnt from, nothing can be told apart:
the score is 0 and the verdict allow; so it is at a score of exactly a half.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.textops import Scratch, column, lookup, ship
from weekloom.llm.words import word_counts

#: Fixed value: a part of a host's name has at most so many characters.
LONGEST_WORD = 63
WINDOW = 64
NAMES = "[a-z]+|[0-9]+|[^\\x00-\\x7f]+"
ADDED = ("host", "path", "rule", "words", "block_score", "verdict")


def parted(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(path, F.lit(""))


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds host, path, rule and rule_verdict to all columns."""
    host, path = parted(F.col("url"))
    out = urls.withColumn("host", host).withColumn("path", path)
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1] + r[2]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in ordered]
    chosen = lambda values: reduce(lambda rest, x: F.when(x[0], F.lit(x[1])).otherwise(rest), list(zip(fits, values, strict=True))[::-1], F.lit(None).cast("string"))
    return out.withColumn("rule", chosen([h + p for _, h, p in ordered])).withColumn("rule_verdict", chosen([v for v, _, _ in ordered]))


class Segmenter:
    """Cuts a name into known words by Viterbi search; ``total`` is the number of words that the counts are shares of."""

    def __init__(self, total: int):
        self.total = float(np.log(max(total, 1)))
        self.unknown = float(np.log(0.01)) - self.total

    def log(self, n: int) -> float:
        return float(np.log(n)) - self.total

    def cut(self, name: str, known: list[tuple[int, int, int]]) -> list[str]:
        """``known``: start, length and count of each word that occurs in the name.  Of equal cuts, the one with the shorter last word."""
        ending: dict[int, list] = {}
        for i, size, n in sorted(known, reverse=True):
            ending.setdefault(i + size, []).append((i, self.log(n)))
        best, back = [0.0], [0]
        for j in range(1, len(name) + 1):
            top, at = best[j - 1] + self.unknown, j - 1
            for i, p in ending.get(j, ()):
                if best[i] + p > top:
                    top, at = best[i] + p, i
            best.append(top)
            back.append(at)
        words, j = [], len(name)
        while j:
            words.append(name[back[j] : j])
            j = back[j]
        return words[::-1]


def segmented(names: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """name, cut array<string>: each distinct name (column ``name``) cut into words of docs."""
    counts = word_counts(docs, F.lit("")).select(F.col("word").cast("string").alias("word"), "n").where(F.is_valid_utf8("word") & F.length("word").between(2, LONGEST_WORD))
    counts = scratch.put(counts)
    segmenter = Segmenter(counts.agg(F.sum("n")).first()[0] or 0)
    # a long name is taken in windows, and its words go by number, so that what is made grows with its length and not with the square
    numbered = scratch.put(names.withColumn("nid", F.monotonically_increasing_id()))
    windows = numbered.select("nid", "name", F.explode(F.sequence(F.lit(0), F.length("name"), F.lit(WINDOW))).alias("at")).select("nid", "at", F.substr("name", F.col("at") + 1, F.lit(WINDOW + LONGEST_WORD - 1)).alias("piece"))
    size = F.length("piece")
    parts = windows.where(size > 1).select("nid", "at", "piece", F.explode(F.sequence(F.lit(0), F.least(size - 2, F.lit(WINDOW - 1)))).alias("j"))
    parts = parts.select("nid", "at", "piece", "j", F.explode(F.sequence(F.lit(2), F.least(F.lit(LONGEST_WORD), size - F.col("j")))).alias("size"))
    parts = scratch.put(parts.select("nid", (F.col("at") + F.col("j")).alias("i"), "size", F.substr("piece", F.col("j") + 1, F.col("size")).alias("word")))
    known = lookup(parts, counts, "word").groupBy("nid").agg(F.collect_list(F.struct("i", "size", "n")).alias("known"))
    every = numbered.join(known.hint("merge"), "nid", "left")

    @F.arrow_udf("array<string>")
    def cut(names: pa.Array, known: pa.Array) -> pa.Array:
        return pa.array([segmenter.cut(x, [(w["i"], w["size"], w["n"]) for w in own or ()]) for x, own in zip(names.to_pylist(), known.to_pylist(), strict=True)], pa.list_(pa.string()))

    return every.select("name", cut("name", "known").alias("cut"))


def bayes(rows: DataFrame, most_training: int) -> dict[str, float]:
    """Log odds of block to allow for each word seen in urls with a rule's verdict, and under "" for the prior; empty unless both are seen."""
    labelled = rows.where("rule_verdict IS NOT NULL")
    n = {x[0]: x[1] for x in labelled.groupBy("rule_verdict").count().collect()}
    if not (n.get("allow") and n.get("block")):
        return {}
    share = most_training / sum(n.values())
    if share < 1:
        labelled = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(share * 1_000_000))
    seen = labelled.select("rule_verdict", F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(F.col("rule_verdict") == v).alias(v) for v in ("allow", "block")]).toArrow()
    allow, block = (seen[v].to_numpy() + 0.5 for v in ("allow", "block"))
    ratio = np.log(block / block.sum()) - np.log(allow / allow.sum())
    return dict(zip(seen["word"].to_pylist(), ratio.tolist(), strict=True)) | {"": float(np.log(n["block"]) - np.log(n["allow"]))}


def url_filter(urls: DataFrame, docs: DataFrame, rules: list[tuple[str, str, str]], most_training: int = 100_000) -> DataFrame:
    """All columns of urls (those named like an added one are replaced), host, path, rule, words array<string>, block_score double and verdict."""
    spark = ship(urls.sparkSession)
    scratch = Scratch(spark)
    own = [c for c in urls.columns if c not in ADDED]
    row = F.struct(*[column(urls, c).alias(f"c{k}") for k, c in enumerate(own)]).alias("own")
    rows = scratch.put(ruled(urls.select(row, urls["url"].alias("url")), rules))
    hosts = scratch.put(rows.select("host").distinct())
    named = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(NAMES), F.lit(0))).alias("k", "name"))
    cuts = scratch.put(segmented(named.select("name").distinct(), docs, scratch))
    named = lookup(scratch.put(named), cuts, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "cut"))).alias("cuts"))
    words = scratch.put(named.select("host", F.transform(F.flatten("cuts.cut"), lambda w: F.concat(F.lit("h:"), w)).alias("host_words")))
    of_path = F.filter(F.regexp_extract_all(F.lower("path"), F.lit(NAMES), F.lit(0)), lambda w: ~w.rlike("^[0-9]"))
    every = F.concat(F.coalesce("host_words", F.array().cast("array<string>")), F.transform(of_path, lambda w: F.concat(F.lit("p:"), w)))
    rows = scratch.put(lookup(rows, words, "host", "left").withColumn("words", every).drop("host_words"))
    model = spark.sparkContext.broadcast(bayes(rows, most_training))

    @F.arrow_udf("double")
    def judged(lists: pa.Array) -> pa.Array:
        weights = model.value
        if not weights:
            return pa.array(np.zeros(len(lists)))
        z = np.array([weights[""] + sum(weights.get(w, 0.0) for w in words) for words in lists.to_pylist()], float)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    done = rows.withColumn("block_score", judged("words"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return done.select(*[F.col(f"own.c{k}").alias(c) for k, c in enumerate(own)], "host", "path", "rule", "words", "block_score", verdict.alias("verdict"))
