"""Transducers against dictionaries, and whole results against plain counting."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from weekloom.llm import collocations
from weekloom.llm.queries import ORACLE, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top, inside=100, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    around[p[s : s + m]] = max(around[p[s : s + m]], a)
        rows = []
        for p, a in found.items():
            if not (around[p] and 100 * around[p] >= inside * a):
                score, _, left, right = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "É", "a\x01", "a", "ab", "z\x0f", "Z", "漢字", "x-y", "'s", *(f"w{i}" for i in range(25))]
    fixed = ["in New York city hall", "of the", "the the the the the the", "once upon a time there was", "a a\x01 a"]
    docs = [("en", None), ("en", ""), (None, " \t "), (None, "the of the of"), ("de", "."), ("fr", "a.b,c;d:e!f?g\nh\ri\x0bj\x0ck")]
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(1, 60))]
        docs.append((rng.choice(["en", "en", "de", None, ""]), "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for p in parts)))
    return docs + docs[:60] + [("en", "in new york city hall " * 3000)]


@pytest.mark.parametrize(("block", "least", "top", "inside"), [(500, 3, 10_000, 100), (1 << 23, 5, 40, 100), (20_000, 4, 7, 60)])
def test_whole_result(spark, block, least, top, inside):
    docs = corpus(block)
    frame = spark.createDataFrame([(g, t, 1, "q", 2) for g, t in docs], "lang string, text string, rank int, word string, n int").repartition(5)
    found = collocations.collocations(frame, least, 5, inside, top, block_bytes=block, range_words=900)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(docs, least, top, inside)


def test_empty_and_rare(spark):
    schema = "lang string, text string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "one two three")], schema)).count() == 0


def test_query_and_its_sql(spark, tmp_path):
    docs = corpus(9, 900)
    spark.createDataFrame([(i, t, g, "s", 1) for i, (g, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op13_collocations"](spark, str(tmp_path)).collect()))
    assert got == brute(docs, 100, 2000) and len(got) > 40
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(ORACLE["op13_collocations"]).fetchall()) == got


@pytest.mark.parametrize("summed", [True, False])
def test_transducer(summed, monkeypatch):
    monkeypatch.setattr(collocations, "BATCH", 7)
    rng = random.Random(4)
    for _ in range(150):
        vocabulary = rng.randint(1, 6)
        sequences = Counter(tuple(rng.randint(1, vocabulary) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(0, 60)))
        if not summed:
            sequences = Counter({s[:k]: rng.randint(1, 5) for s in sequences for k in range(2, len(s) + 1)})
        rows = np.array([[*s, *[0] * (5 - len(s))] for s in sequences], np.int64).reshape(-1, 5)
        weight = np.array(list(sequences.values()), np.int64)
        names = collocations.named([b"w%d" % k for k in range(vocabulary)])
        rows, weight, _ = collocations.distinct(rows, weight)
        made = collocations.build(names, rows, weight, summed)
        made = collocations.Transducer.load(made.dump())
        want = Counter()
        for s, n in sequences.items():
            for k in range(2, len(s) + 1) if summed else [len(s)]:
                want[tuple(names[x - 1] for x in s[:k])] += n
        got = {tuple(made.names[x - 1] for x in r): n for found, w in made.expand() if found.shape[1] > 1 for r, n in zip(found.tolist(), w.tolist(), strict=True)}
        assert got == want
        states = [tuple(map(tuple, np.column_stack([made.label, made.weight, made.target])[a:b])) for a, b in zip(made.first[:-1], made.first[1:], strict=True)]
        assert len(set(states[1:])) == len(states[1:])  # no two states alike: minimal
        asked = [tuple(rng.randint(1, len(made.names) + 1) for _ in range(rng.randint(2, 5))) for _ in range(50)]
        matrix = np.array([[*s, *[0] * (5 - len(s))] for s in asked], np.int64)
        expect = [want.get(tuple(made.names[x - 1] for x in s), 0) if max(s) <= len(made.names) else 0 for s in asked]
        assert made.compose(matrix).tolist() == expect
        united = collocations.united([made, made], 5)
        again = {tuple(united[0][x - 1] for x in r if x): n for r, n in zip(united[1].tolist(), united[2].tolist(), strict=True)}
        assert again == {k: 2 * n for k, n in want.items()}
