"""The automaton, its chains and the scan, against plain versions."""

import itertools
import random
import re

import pytest

from weekloom.llm import licence_scan
from weekloom.llm.queries import LICENCE_PHRASES, LICENCE_TEMPLATES, QUERIES

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORDS.findall((text or "").translate(LOWER))


def base(text):
    words, places, labels = words_of(text), [], set()
    for phrase, label in LICENCE_PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_statistics_and_occurrences():
    rng = random.Random(1)
    for _ in range(150):
        sequences = [[rng.randint(0, 3) for _ in range(rng.randint(2, 14))] for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.3:
            sequences.append(list(sequences[0]))
        a = licence_scan.Automaton(sequences)
        text = [rng.randint(0, 4) for _ in range(60)]
        has = lambda x: {(k, i + len(x)) for k, s in enumerate(sequences) for i in range(len(s) - len(x) + 1) if s[i : i + len(x)] == x}  # noqa: B023, E731
        for at, (state, length) in enumerate(a.statistics(text)):
            longest = next(n for n in range(at + 1, -1, -1) if n == 0 or has(text[at + 1 - n : at + 1]))
            assert length == longest
            if length:
                assert len(a.occurrences[state]) == len(set(a.occurrences[state])) and set(a.occurrences[state]) == has(text[at + 1 - length : at + 1])


def test_chains_cover_most():
    rng = random.Random(2)
    for _ in range(200):
        gap = rng.randint(0, 4)
        anchors = list({(rng.randint(3, 25), rng.randint(3, 14), rng.randint(1, 3)) for _ in range(rng.randint(0, 7))})
        best = 0
        for n in range(1, len(anchors) + 1):
            for chain in itertools.combinations(sorted(anchors), n):
                covered = chain[0][2]
                for x, y in itertools.pairwise(chain):
                    if not (x[0] < y[0] and x[1] < y[1] and y[0] - y[2] - x[0] <= gap and y[1] - y[2] - x[1] <= gap):
                        break
                    covered += min(y[2], y[0] - x[0], y[1] - x[1])
                else:
                    best = max(best, covered)
        found = licence_scan.chained(anchors, gap)
        assert max((x[2] for x in found), default=0) == best
        assert all(x[1] < y[0] for x, y in itertools.pairwise(found))


def test_anchors_are_all_that_cannot_be_prolonged():
    """Against every pair of places, for each template."""
    rng = random.Random(3)
    letters = ["ab", "cd", "éf", "9"]
    for _ in range(60):
        templates = tuple((" ".join(rng.choice(letters) for _ in range(rng.randint(3, 12))), f"t{i}") for i in range(3))
        held = licence_scan.Scanner(templates, (("ab cd", "p"),), 3, 4)
        text = " ".join(rng.choice([*letters, "zz"]) for _ in range(50))
        words, of = held.numbered(licence_scan.Chunk(0, [text.encode()]))
        found: dict = {}
        phrases: list = []
        for lo, hi in held.runs(words, of):
            held.matches(words[lo:hi].tolist(), lo, phrases, found)
        w = text.split()
        for k, (template, _) in enumerate(templates):
            t = template.split()
            want = set()
            for i in range(len(w)):
                for j in range(len(t)):
                    if w[i] == t[j] and (i == 0 or j == 0 or w[i - 1] != t[j - 1]):
                        n = next(n for n in itertools.count(1) if i + n >= len(w) or j + n >= len(t) or w[i + n] != t[j + n])
                        if n >= 3:
                            want.add((i + n, j + n, n))
            assert set(found.get(k + 1, [])) == want and len(found.get(k + 1, [])) == len(want)
        assert sorted(at for _, at in phrases) == [i for i in range(len(w) - 1) if w[i : i + 2] == ["ab", "cd"]]


TEXTS = [
    None, "", " .,;", "cc by", "CC-BY cc by by cc BY\nby", "All rights reserved. all rights, reserved", "the GNU GENERAL public license; general public licenses", "all rights all rights reserved reserved",
    "Straße cc\xa0by ccby", "cc\x00by", "x " * 5000 + "cc by " + "general public license " * 3, "Released under the MIT License.", "LICENSED UNDER CC BY-NC 4.0.", "İcc by K",
]


def test_scan(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join(rng.choice(["lorem", "the", "under", "ipsum", "of", "license", "is", "dolor"]) for _ in range(n))
    planted = []
    for text, label in LICENCE_TEMPLATES:
        words = words_of(text)
        for every in (0, 12):
            if not every or len(words) > 20:
                own = [w if not every or i % every != every - 2 else "changed" for i, w in enumerate(words)]
                planted.append((noise(30) + " " + " ".join(own).upper() + " " + noise(30), label, len(words_of(noise(0))) + 30, 29 + len(words)))
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, x[0]) for i, x in enumerate(planted)] + [(3, "cc by again"), (None, "cc by")] + [(500 + i, noise(60)) for i in range(20)]
    rows = spark.createDataFrame([(i, t, "z", "y") for i, t in docs], "doc_id long, text string, labels string, spans string").repartition(3)
    got = licence_scan.licence_scan(rows, LICENCE_TEMPLATES, LICENCE_PHRASES).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted([(r.doc_id, *r[1:6]) for r in got], key=key) == sorted([(i, *base(t)) for i, t in docs], key=key)
    by_id = {r.doc_id: r for r in got}
    for i, (_, label, lo, hi) in enumerate(planted):
        r = by_id[100 + i]
        assert label in r.labels.split(","), (label, r)
        assert any(x.label == label and x.first_word >= lo - 2 and x.last_word <= hi + 2 and x.last_word - x.first_word >= 0.6 * (hi - lo) for x in r.spans)
    for r in got:
        labels = set(filter(None, r.labels.split(",")))
        assert set(filter(None, r.base_labels.split(","))) <= labels and labels == set(filter(None, r.base_labels.split(","))) | {x.label for x in r.spans}
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base) and all(x.share >= 0.7 for x in r.spans)
    assert all(by_id[500 + i].labels == "" and by_id[500 + i].score < 0.7 for i in range(20))
    assert by_id[0].score == by_id[1].score == 0 and by_id[0].spans == []


def test_repeated_notices_in_one_text(spark):
    text = "Released under the MIT License. " * 400
    got = licence_scan.licence_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), LICENCE_TEMPLATES, LICENCE_PHRASES).first()
    mine = [x for x in got.spans if x.template == 0]
    assert [(x.first_word, x.last_word) for x in mine] == [(5 * i, 5 * i + 4) for i in range(400)]


def test_empty_table_and_bad_templates(spark):
    assert licence_scan.licence_scan(spark.createDataFrame([], "doc_id long, text string"), LICENCE_TEMPLATES, LICENCE_PHRASES).count() == 0
    with pytest.raises(ValueError):
        licence_scan.Scanner((("one two", "x"),), (), 3, 8)


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_license_scan"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted((i, *base(t)) for i, t in enumerate(TEXTS))
