"""Each operator against a plain version, on small inputs with every awkward case."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from weekloom.llm import decontaminate, language_id, line_dedup, near_dedup, packing, quality_rules, suffix_array, suffix_dedup, token_count, toxicity, url_filter
from weekloom.llm.pretokens import default_path, tokenizer, units
from weekloom.llm.queries import URL_RULES, fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score string, row int, key string, n_lines string"
EMPTY_LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=1, n=60):
    """Copies, near copies, repeated lines and words, blanks of all kinds, null and empty texts, one very long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["na", "to", "ré", "li", "su", "ño", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = ["A line that many documents share, " + line(4), "\tAnother Shared LINE of some length " + line(3) + " \r", line(25)]
    texts = [None, "", " \n\t\n", "short", "one two three", "☃ ☃ ☃", "١٢٣ 漢字 ", "x" * 70]
    for _ in range(n):
        lines = [line(rng.randint(1, 40)) for _ in range(rng.randint(1, 8))]
        for s in shared:
            if rng.random() < 0.4:
                lines.insert(rng.randint(0, len(lines)), s)
        if rng.random() < 0.3:
            lines.append(lines[0])
        if rng.random() < 0.2:
            lines.append(" ".join([line(9)] * 4))
        texts.append("\n".join(lines))
    long = [t for t in texts if t and len(t) > 900][:4]
    texts += long + [t.replace(" na", " otro", 1) for t in long] + [" ".join(w if i != 40 else "changed" for i, w in enumerate(t.split(" "))) for t in long] * 2
    texts.append("\n".join(line(30) for _ in range(900)))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(7 * i + 3, texts[k]) for i, k in enumerate(order)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "xx" if i % 5 else None, None, None, "own", 1, "k", "n") for i, t in docs], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs():
    return corpus()


def rows_of(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


@pytest.mark.parametrize("groups", [None, 16, 3, 1])
def test_suffix_array_and_prefixes(monkeypatch, groups):
    """With buckets alone and in groups at every level."""
    if groups:
        monkeypatch.setattr(suffix_array, "ALPHABET", 1)
        monkeypatch.setattr(suffix_array, "groups_for", lambda n: groups)
    rng = np.random.default_rng(3)
    for turn in range(150):
        text = rng.integers(0, rng.integers(1, 4), 2500 if turn < 3 else rng.integers(1, 50)).astype(np.uint8)
        if rng.random() < 0.3:
            text = np.tile(text, 4)
        body = text.tobytes()
        want = sorted(range(len(body)), key=lambda i: body[i:])
        assert suffix_array.suffix_array(text, 256).tolist() == want
        shared = suffix_array.common_prefixes(text, np.array(want))
        for a, b in zip(want, want[1:], strict=False):
            n = 0
            while n < len(body) - max(a, b) and body[a + n] == body[b + n]:
                n += 1
            assert shared[b] == n


def test_suffix_dedup_with_frequent_substrings(spark):
    """A long passage and a ruler in most documents, some within one task, some not; the sample changes no result."""
    rng = random.Random(31)
    letters = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    passage = letters(400)
    texts = [(3 * i, letters(rng.randint(0, 120)) + passage[rng.randint(0, 60) :] + "-" * rng.randint(40, 130) + letters(rng.randint(0, 90))) for i in range(150)]
    want = brute.suffix_dedup(texts)
    for sample in (1000, 60, 1):
        got = suffix_dedup.suffix_dedup(frame(spark, texts), sample=sample, most=50)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got.collect()} == want


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup(spark, docs, most):
    got = suffix_dedup.suffix_dedup(frame(spark, docs), most=most)
    want = brute.suffix_dedup(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got.collect()} == want
    assert sum(x[1] for x in want.values()) > 1000


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup_of_a_paragraph_twice_in_one_document(spark, most):
    rng = random.Random(11)
    letters = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    texts = []
    for i in range(20):
        phrase = letters(70)
        paragraph = letters(90) + phrase + letters(90)
        texts += [(2 * i, letters(200) + phrase + letters(200)), (2 * i + 1, paragraph + "\n" + letters(150) + paragraph + letters(40) + paragraph)]
    got = suffix_dedup.suffix_dedup(frame(spark, texts), most=most)
    want = brute.suffix_dedup(texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got.collect()} == want
    assert all(want[2 * i + 1][2] == 3 for i in range(20))


def test_line_dedup(spark, docs):
    got = line_dedup.line_dedup(frame(spark, docs), batches=5, fanout=2)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "row", "key", "n_lines", "n_dropped"]
    found = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()}
    assert found == brute.line_dedup(docs)
    assert any(x[1] for x in found.values())


@pytest.mark.parametrize("min_docs", [2, 3, 4])
def test_line_runs_stay_few(spark, docs, min_docs, monkeypatch):
    """Runs are merged by levels, and lines that wait over several batches go when their key is settled."""
    monkeypatch.setattr(line_dedup, "FREQUENT", 4)
    runs = line_dedup.LineRuns(spark, fanout=2, min_docs=min_docs)
    top = max(i for i, _ in docs) + 1
    for k in reversed(range(6)):
        runs.add(frame(spark, docs).where(F.col("doc_id").between(k * top // 6, (k + 1) * top // 6 - 1)))
    assert [len(level) for level in runs.levels] == [0, 1, 1]
    found = {r.doc_id: r.n_dropped for r in runs.clean(frame(spark, docs)).collect()}
    assert found == {i: x[1] for i, x in brute.line_dedup(docs, min_docs).items()}
    assert min_docs > 3 or any(found.values())
    with pytest.raises(ValueError, match="descending"):
        runs.add(frame(spark, docs))


def test_very_frequent_lines_and_clashing_names(spark):
    line = "a line that nearly every document holds, " * 2
    texts = [(i, "\n".join([line, f"a line of its own, number {i}, long enough", line.upper()] if i % 10 else ["short", line])) for i in range(2500)]
    texts += [(5, line + "\nother rows of a document count once"), (5, line), (None, line), (9000, None)]
    rows = spark.createDataFrame([(i, t, "a", "b", "c", "d", 7) for i, t in texts], "doc_id long, text string, gone_keys string, cleaned_ string, `a.b` string, `row` string, n_lines int")
    got = line_dedup.line_dedup(rows.repartition(7))
    assert got.columns == ["doc_id", "text", "gone_keys", "cleaned_", "a.b", "row", "n_lines", "n_dropped"]
    found = sorted((r.doc_id or -1, r.text, r["a.b"], r.n_lines, r.n_dropped) for r in got.collect())
    want = []
    for i, text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i in (None, 2499) or x.strip().lower() != line.strip()]
        want.append((i or -1, "\n".join(kept), "c", len(lines), len(lines) - len(kept)))
    assert found == sorted(want)


def test_near_duplicates(spark, docs):
    got = rows_of(near_dedup.near_duplicates(frame(spark, docs)))
    want = brute.near_groups(docs)
    assert {i: r.group_id for i, r in got.items()} == want
    assert sum(i != g for i, g in want.items()) >= 8
    kept = {r.doc_id for r in near_dedup.keep_one(frame(spark, docs)).collect()}
    assert kept == {i for i, g in want.items() if i == g}


def test_large_near_copy_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    texts = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(300)] = f"own{i}"
        texts.append((i, " ".join(words)))
    got = rows_of(near_dedup.near_duplicates(frame(spark, texts), all_pairs=4))
    assert {r.group_id for r in got.values()} == {0}


def test_near_pairs_among_documents_of_one_template(spark):
    """Pairs at about 0.82 among 1000 documents that are about 0.75 alike: groups and numbers of links as by brute force."""
    rng = random.Random(14)
    fresh = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    template = fresh(304)
    texts = []
    for i in range(500):
        shared = fresh(22)
        texts += [(2 * i + k, " ".join(template + shared + fresh(29 if i < 50 else 51))) for k in (0, 1)]
    rng.shuffle(texts)
    bags = {i: set(brute.bag(t)) for i, t in texts}
    core = set(brute.bag(" ".join(template)))
    rest = {i: b - core for i, b in bags.items()}
    near = {(a, b) for a in bags for b in bags if a < b and (both := len(core) + len(rest[a] & rest[b])) / (len(bags[a]) + len(bags[b]) - both) >= 0.8}
    links = Counter(i for pair in near for i in pair)
    got = rows_of(near_dedup.near_duplicates(frame(spark, texts)))
    assert len(near) >= 50 and {i: got[i].n_links for i in bags} == {i: links[i] for i in bags}
    root = dict(zip(bags, bags, strict=True))
    for a, b in sorted(near) * 3:
        root[a] = root[b] = min(root[a], root[b])
    assert {i: got[i].group_id for i in bags} == root


def test_links_of_a_large_near_copy_group_are_all_counted(spark):
    rng = random.Random(15)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    texts = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(300)] = f"own{i}"
        texts.append((i, " ".join(words)))
    got = rows_of(near_dedup.near_duplicates(frame(spark, texts), part=16))
    assert {(r.group_id, r.n_links) for r in got.values()} == {(0, 59)}


def test_signatures_estimate_weighted_overlap():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = rng.integers(1, 30, 60), rng.integers(1, 30, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    registers = 4096
    values = near_dedup.signatures(np.r_[hashes, hashes], np.repeat([0, 1], 60), np.r_[a, b], 2, registers)
    assert abs((values[0] == values[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / registers)


def test_components(spark):
    pairs = [(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(100, 105), (105, 102), (100, 102)]
    links = spark.createDataFrame(pairs, "a long, b long")
    from weekloom.llm.textops import Scratch

    got = {r.node: r.root for r in near_dedup.components(links, Scratch(spark)).collect()}
    assert got == {k: k // 10 * 10 for k in range(40)} | {100: 100, 102: 100, 105: 100}


def test_decontamination(spark, docs):
    rng = random.Random(2)
    item = [f"term{rng.randint(0, 400)}" for _ in range(40)]
    edited = list(item)
    edited[5], edited[20] = "other", "else"
    del edited[30]
    half = item[:18] + [f"gone{k}" for k in range(22)]
    planted = [(9001, "before it. " + " ".join(item).upper() + " and after"), (9002, "x y z " + ", ".join(edited)), (9003, " ".join(half)), (9004, None), (9005, " ".join(item[:39]))]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "only four words here"), (None, "no id at all for this one")] * 2, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, docs + planted), benchmark).collect()}
    assert set(got) == {(9001, 1), (9002, 1), (9005, 1)}
    assert got[9001, 1].n_edits == 0 and got[9002, 1].n_edits == 3 and got[9001, 1].start_word == 2
    kept = {r.doc_id for r in decontaminate.decontaminate(frame(spark, docs + planted), benchmark).collect()}
    assert kept == {i for i, _ in docs} | {9003, 9004}
    assert decontaminate.contaminated(frame(spark, docs), benchmark.limit(0)).count() == 0


def edited(rng, words, edits, kinds, fresh):
    """The words with so many edits of these kinds, each at a place of its own."""
    out = list(words)
    for at in sorted(rng.sample(range(len(words)), edits), reverse=True):
        kind = rng.choice(kinds)
        out[at : at + 1] = {"replace": [fresh()], "insert": [fresh(), out[at]], "delete": []}[kind]
    return out


@pytest.mark.parametrize("kinds", [["replace"], ["insert"], ["delete"], ["replace", "insert", "delete"]])
def test_decontamination_recall_at_the_bound(spark, kinds):
    """Items of 6 to 300 words, as many edits as are allowed: at least 0.95 found in each class of sizes, nothing else, the edits as counted."""
    rng = random.Random(12)
    sizes = [rng.randint(lo, hi) for lo, hi in ((6, 11), (12, 20), (21, 40), (41, 80), (100, 150), (200, 300)) for _ in range(40)]
    items = [[f"v{rng.randint(0, 20000)}" for _ in range(n)] for n in sizes]
    other = lambda k: [f"o{rng.randint(0, 900)}" for _ in range(k)]
    planted = [(k, " ".join(other(50) + edited(rng, item, len(item) // 5, kinds, lambda: f"n{rng.randrange(10**6)}") + other(50))) for k, item in enumerate(items)]
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontaminate.contaminated(frame(spark, planted), benchmark).collect()}
    assert all(a == b and n <= sizes[a] // 5 for (a, b), n in got.items())
    for lo in range(0, 240, 40):
        assert sum((k, k) in got for k in range(lo, lo + 40)) >= 38


def test_decontamination_in_blocks_and_short_items(spark):
    rng = random.Random(8)
    items = [[f"v{rng.randint(0, 900)}" for _ in range(n)] for n in [1, 2, 3, 4] + [rng.randint(5, 55) for _ in range(40)]]
    other = lambda k: [f"o{rng.randint(0, 900)}" for _ in range(k)]
    planted = [(k, " ".join(other(30) + item + other(30))) for k, item in enumerate(items)]
    planted += [(1000 + k, " ".join(item[:-1] + ["x", item[-1]])) for k, item in enumerate(items[1:4])]  # short items are found word by word only
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] * 2, "item_id long, text string")
    want = {(d, k) for d, text in planted for k, x in enumerate(items) if k < 4 and f" {' '.join(x)} " in f" {text} "} | {(k, k) for k in range(len(items))}
    for size in (1 << 20, 2000):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, planted), benchmark, block_bytes=size).collect()} == want
    assert {r.doc_id for r in decontaminate.decontaminate(frame(spark, planted), benchmark, block_bytes=2000).collect()} == {i for i, _ in planted} - {i for i, _ in want}


def test_decontamination_in_very_long_texts(spark):
    rng = random.Random(3)
    item = [f"v{rng.randint(0, 20000)}" for _ in range(60)]
    long = [f"o{rng.randint(0, 900)}" for _ in range(400_000)]
    long[350_000:350_000] = edited(rng, item, 12, ["replace", "delete"], lambda: "new")
    same = " ".join(["the"] * 50_000)
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "the " * 30)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, [(1, " ".join(long)), (2, same)]), benchmark).collect()}
    assert got == {(1, 1), (2, 2)}


def test_walks_where_the_goal_is_out_of_reach(spark, monkeypatch):
    """All items of the size are then verified."""
    monkeypatch.setattr(decontaminate, "walks_for", lambda n, edits, recall: (0, 0))
    rows = [(k, f"alpha{k} beta gamma delta epsilon zeta eta theta".encode()) for k in range(5)]
    words = decontaminate.Items(rows, 0.2, {8: (0, 0)}).matches(decontaminate.Chunk(0, [b"x beta gamma delta epsilon zeta eta theta"]))
    assert sorted(i for _, i, *_ in words) == list(range(5))


def test_nearest_is_the_edit_distance():
    rng = random.Random(13)
    for _ in range(300):
        item, stretch = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        last = [0] * (len(stretch) + 1)
        for i, x in enumerate(item, 1):
            row = [i]
            for j, y in enumerate(stretch, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
            last = row
        assert decontaminate.nearest(item, stretch, 12) == min(last)


def test_base_rules(spark, docs):
    labels = spark.createDataFrame([], EMPTY_LABELS)
    got = rows_of(quality_rules.quality(frame(spark, docs), labels))
    for i, text in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_rules(text)
        assert r.kept == (not r.base_failed)  # nothing is certified without labels


def test_certified_cutoffs(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = [("LOUD" + str(rng.randint(0, 99)) + "!!") if bad else f"word{rng.randint(0, 999)}" for _ in range(60)]
        texts.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, 0))
    got = rows_of(quality_rules.quality(frame(spark, [(i * 5 + 1, t) for i, t in texts]), spark.createDataFrame([(i * 5 + 1, q, t) for i, q, t in labels], EMPTY_LABELS)))
    assert all(got[i * 5 + 1].kept == (i % 3 != 0) for i in range(900))


def test_binomial_tail():
    assert quality_rules.binomial_tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert quality_rules.binomial_tail(3, 12, 0.25) == pytest.approx(sum(math.comb(12, k) * 0.25**k * 0.75 ** (12 - k) for k in range(4)))


def test_token_counts(spark, docs):
    with open(default_path(), encoding="utf-8") as file:
        vocabulary = set(json.load(file)["model"]["vocab"])
    letters = token_count.byte_letters()

    def greedy(unit):
        symbols = [letters[b] for b in unit.encode()]
        symbols[-1] += "</w>"
        n = at = 0
        while at < len(symbols):
            at = next(j for j in range(len(symbols), at, -1) if "".join(symbols[at:j]) in vocabulary)
            n += 1
        return n

    extra = [(5000, "It's <|endoftext|> İstanbul ﬁne ½ don't!! 2024"), (5001, "naïve\x1ctest\xa0é e\u0301")]
    got = rows_of(token_count.token_counts(frame(spark, docs + extra)))
    for i, text in docs + extra:
        assert got[i].n_tokens == sum(map(greedy, units(text or ""))), text


def test_packing(spark, docs):
    extra = [(5000, "It's <|endoftext|> İstanbul ﬁne ½ don't!! 2024"), (5001, "naïve\x1ctest\xa0é e\u0301 ΑΣ"), (5002, "tab\tand ² and _x_")]
    every = dict(docs + extra)
    for size in (64, 2048):
        rows = packing.pack(frame(spark, docs + extra), size=size).collect()
        load, pieces, sequences = tokenizer(default_path()), {}, {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append(r)
            sequences.setdefault(r.sequence_id, []).append(r)
        assert set(pieces) == set(every)
        for i, own in pieces.items():
            ids = load.encode(every[i] or "", add_special_tokens=False).ids + [1]
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.length) == (at, len(ids), len(r.tokens))
                assert list(r.tokens) == ids[at : at + r.length]
                assert r.ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes())
                at += r.length
            assert at == len(ids)
        for own in sequences.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at == size or at < size and at & (at - 1) == 0


def test_language(spark):
    rng = random.Random(6)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ei", "ver"], "cc": ["ción", "ez", "os", "que"]}
    text = lambda g: " ".join("".join(rng.choice(sounds[g]) for _ in range(rng.randint(1, 4))) for _ in range(30))
    rows = [(i, text(g := "aa bb cc".split()[i % 3]), g, g) for i in range(240)] + [(900, None, "aa", ""), (901, "12 34 !!", "bb", ""), (902, "", None, ""), (903, "漢字", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = rows_of(language_id.language_id(docs, docs.where((fold(4) != 2) & F.col("lang").isNotNull())))
    assert all(got[i].lang_pred == "aa bb cc".split()[i % 3] and 0 <= got[i].score <= 1 for i in range(240))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in sounds
    nothing = rows_of(language_id.language_id(docs, docs.limit(0)))
    assert {r.lang_pred for r in nothing.values()} == {"und"}


def every_cut(word, words):
    """All ways to cut a word into pieces, each a list of piece numbers."""
    index = {t: i + 1 for i, t in enumerate(words.texts)}

    def cuts(rest):
        if not rest:
            yield []
        for k in range(1, len(rest) + 1):
            if rest[:k] in index:
                for more in cuts(rest[k:]):
                    yield [index[rest[:k]], *more]

    return list(cuts(word))


def test_forward_sums_and_expected_counts_over_all_cuts():
    words = language_id.pieces(default_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    logs = np.log(rng.random((len(words), 2)))
    texts = [b"the", b"station", "année".encode(), b"a", b"orientation"]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(x) for x in texts])
    lattice = language_id.Lattice(words, buf, np.r_[0, ends[:-1]], ends)
    got = lattice.sums(logs)[lattice.last]
    weight, want = np.array([3.0, 1, 2, 5, 1]), np.zeros(len(words))
    for k, text in enumerate(texts):
        cuts = every_cut(text, words)
        for lang in (0, 1):
            assert got[k, lang] == pytest.approx(math.log(sum(math.exp(logs[c, lang].sum()) for c in cuts)))
        total = sum(math.exp(logs[c, 0].sum()) for c in cuts)
        for c in cuts:
            np.add.at(want, c, weight[k] * math.exp(logs[c, 0].sum()) / total)
    assert np.allclose(language_id.expected(texts, weight, words, logs[:, :1]), want)


def test_long_pieces_and_long_words():
    words = language_id.pieces(default_path("piece_bpe_32k.model"))
    for word in (b"orientation", b"descriptions"):
        assert word in words.texts and [words.texts.index(word) + 1] in every_cut(word, words)
    word = np.frombuffer(b"orientation" * 3000, np.uint8)
    logs = np.log(np.full((len(words), 1), 1e-3))
    lattice = language_id.Lattice(words, word, np.array([0]), np.array([len(word)]))
    assert len(word) / 11 * math.log(1e-3) < lattice.sums(logs)[-1, 0] < 0
    assert lattice.sums(logs)[-1, 0] == pytest.approx(lattice.sums(logs, back=True)[0, 0])


def test_toxicity(spark):
    rng = random.Random(9)
    clean = [f"w{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.randint(0, 30)}" for _ in range(200)]
    bad = ["vilea", "vileb", "rotten", "foulish"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        words = [rng.choice(clean) for _ in range(40)]
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i * 3, " ".join(words), "own"))
        if i % 5 < 2:
            labels.append((i * 3, 1, int(toxic)))
    rows += [(100_001, None, ""), (100_002, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, EMPTY_LABELS), fold(5) != 0)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    found = rows_of(got)
    right = sum(found[i * 3].predicted == int(i % 6 == 0) for i in range(1200))
    assert right >= 1190 and found[100_001].predicted == found[100_002].predicted == 0
    none = toxicity.toxicity(docs, spark.createDataFrame([], EMPTY_LABELS), fold(5) != 0)
    assert none.where("predicted = 1").count() == 0


def test_url_filter(spark, docs):
    urls = ["http://Blog.Example.COM/en/7?x=1", "https://a.net/de/3", "http://example.net/de/85", "http://org/es/", "http://notorg/es/1", "no scheme/here", None, "x://", "ftp://u@h.org:80#f/es/", "http://a.com?/en/1", "http://b.example.org/fr/1\nnext"]
    urls += [f"http://shop{k}.example.com/en/1{k}" for k in range(20)] + [f"http://blog{k}.net/de/{k}" for k in range(20)] + [f"http://shop{k}.xyz/page" for k in range(5)]
    docs = docs + [(9000, "a" + "é" * 40 + " " + "漢字" * 30)]  # a word longer than is kept, cut within a character
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("own"))
    got = rows_of(url_filter.url_filter(pages, frame(spark, docs), URL_RULES), "page_id")
    for k, url in enumerate(urls):
        host, path = brute.url_parts(url)
        rule, verdict = brute.url_rule(host, path, URL_RULES)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert verdict in (None, got[k].verdict) and got[k].verdict in ("allow", "block")
    assert all(got[k].verdict == "block" for k in range(len(urls) - 5, len(urls)))
    assert url_filter.url_filter(pages.limit(0), frame(spark, docs[:0]), URL_RULES).count() == 0


def test_segmenter():
    """Against all cuts of a name into words of the dictionary and single unknown characters."""
    counts = {"news": 50, "paper": 40, "newspaper": 5, "daily": 30, "new": 20, "spaper": 1}
    segmenter = url_filter.Segmenter(sum(counts.values()))

    def best(rest):
        if not rest:
            return 0.0
        known = [segmenter.log(counts[rest[:k]]) + best(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in counts]
        return max([segmenter.unknown + best(rest[1:]), *known])

    for name in ("dailynewspaper", "newsxdaily", "", "newspapernews", "xyz", "newnewspaperdaily"):
        cut = segmenter.cut(name, [(i, len(w), n) for w, n in counts.items() for i in range(len(name)) if name.startswith(w, i)])
        assert "".join(cut) == name
        assert sum(segmenter.log(counts[w]) if w in counts else segmenter.unknown for w in cut) == pytest.approx(best(name))


def test_url_verdicts_against_plain_bayes(spark):
    """Segmentation and naive Bayes over whole tables, with a host that holds a third of the rows, against plain versions."""
    rng = random.Random(21)
    words = ["shop", "blog", "news", "daily", "cats", "dogs", "best", "sale"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(50)] + [(99, None)]
    urls = [f"https://{rng.choice(words)}{rng.choice(words)}{rng.choice(['', 'x7'])}.{rng.choice(['com', 'net', 'xyz'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.choice(words)}-{rng.choice(words)}/{k}" for k in range(900)]
    urls += ["http://verylarge" + "host" * 40 + f".org/en/{k % 7}" for k in range(2000)] + [None, "none"]
    pages = spark.createDataFrame([(k, u, 1, 2) for k, u in enumerate(urls)], "page_id long, url string, `own name` int, words int")
    got = rows_of(url_filter.url_filter(pages.repartition(6), frame(spark, docs), URL_RULES), "page_id")
    counts = Counter(w for _, t in docs for w in (t or "").split())
    total = sum(counts.values())

    def cut(name):
        best = [(0.0, [])]
        for j in range(1, len(name) + 1):
            options = [(best[j - 1][0] + math.log(0.01 / total), [*best[j - 1][1], name[j - 1]])]
            options += [(best[i][0] + math.log(counts[name[i:j]] / total), [*best[i][1], name[i:j]]) for i in range(j) if name[i:j] in counts]
            best.append(max(options, key=lambda x: x[0]))
        return best[-1][1]

    pieces = lambda text: re.findall("[a-z]+|[0-9]+", text)
    seen, labels = {}, {}
    for k, url in enumerate(urls):
        host, path = brute.url_parts(url)
        seen[k] = ["h:" + w for name in pieces(host) for w in cut(name)] + ["p:" + w for w in pieces(path.lower()) if not w.isdigit()]
        labels[k] = brute.url_rule(host, path, URL_RULES)[1]
    n = {v: Counter(w for k, own in seen.items() if labels[k] == v for w in own) for v in ("allow", "block")}
    known = set(n["allow"]) | set(n["block"])
    odds = {w: math.log((n["block"][w] + 0.5) / (n["block"].total() + 0.5 * len(known))) - math.log((n["allow"][w] + 0.5) / (n["allow"].total() + 0.5 * len(known))) for w in known}
    prior = math.log(sum(v == "block" for v in labels.values()) / sum(v == "allow" for v in labels.values()))
    assert len(got) == len(urls) and got[0]["own name"] == 1
    for k in seen:
        z = prior + sum(odds.get(w, 0) for w in seen[k])
        assert got[k].words == seen[k] and got[k].block_score == pytest.approx(1 / (1 + math.exp(-z)))
        assert got[k].verdict == (labels[k] or ("block" if z > 0 else "allow"))


@pytest.mark.parametrize("rows", [[], [(None, None), (3, None), (3, "again and again"), (3, "again and again"), (4, "")]])
def test_empty_and_null_tables(spark, rows):
    """Empty tables give empty results; null ids, null texts and repeated rows do not fail."""
    docs = frame(spark, [])
    if rows:
        docs = spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([], EMPTY_LABELS)
    n = len(rows)
    assert token_count.token_counts(docs).count() == n
    assert quality_rules.quality(docs, labels).count() == n
    assert near_dedup.keep_one(docs).count() == n
    assert near_dedup.near_duplicates(docs).count() == len({i for i, _ in rows} - {None})
    assert line_dedup.line_dedup(docs).count() == n
    assert suffix_dedup.suffix_dedup(docs).count() == n
    assert packing.pack(docs).select("doc_id", "start").count() == n
    assert language_id.language_id(docs, docs).count() == n
    assert toxicity.toxicity(docs, labels, fold(5) != 0).count() == n
    assert decontaminate.decontaminate(docs, spark.createDataFrame([(1, "again and again")], "item_id long, text string")).count() == max(n - 2, 0)  # row by row


def test_placement_is_the_least_sum_of_squares():
    """Against trying every window, and a new one, for each piece."""
    rng = random.Random(17)
    size, fitter, levels = 16, packing.SumOfSquares(16), Counter()
    squares = lambda c: sum(n * n for level, n in c.items() if level < size)
    for k in range(400):
        n = rng.randint(1, size - 1)
        options = []
        for h in [0, *sorted(level for level, count in levels.items() if count and level + n <= size)]:
            after = Counter(levels)
            after[h] -= h > 0
            after[h + n] += h + n < size
            options.append((squares(+after), h, +after))
        least = min(x[0] for x in options)
        full = fitter.place((k, 0, np.zeros(n, "<i4"), n))
        levels = Counter({int(h): int(fitter.count[h]) for h in np.flatnonzero(fitter.count[:size]) if h})
        assert squares(levels) == least and (full is None or full.fill == size)


def test_risk_falls_and_is_kept_from_below():
    """Non-negative PU learning tells two classes apart though the unlabelled sample holds positives."""
    rng = np.random.default_rng(5)
    kind = np.r_[np.ones(300, int), np.zeros(1000, int)]
    toxic = np.r_[np.ones(300, bool), rng.random(1000) < 0.2]
    rows = [np.unique(np.r_[rng.integers(0, 20, 6), [20] if t and rng.random() < 0.9 else []].astype(np.int64)) for t in toxic]
    weight = toxicity.nnpu(kind, rows, [np.ones(len(x)) for x in rows], 21, 0.2)
    z = np.array([weight[x].sum() + weight[x + 21].sum() for x in rows]) + weight[-1]
    assert (z[300:][toxic[300:]] > 0).mean() > 0.85 and (z[300:][~toxic[300:]] > 0).mean() < 0.02


def test_clashing_names_and_very_long_texts(spark):
    """Extra columns named like those that operators add or use, a text of one long word and one of very many words."""
    names = ["score", "kept", "shard", "stratum", "n_words", "rule", "host", "sample_id", "gone", "least", "row", "a.b", "doc id"]
    texts = [(1, "word " * 300_000), (2, "x" * 500_000), (3, "some words of a plain text"), (4, None), (4, "some words of a plain text"), (None, "")]
    docs = spark.createDataFrame([(i, t, "xx", *["own"] * len(names)) for i, t in texts], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1)], EMPTY_LABELS)
    n = len(texts)
    assert sorted(r.n_tokens for r in token_count.token_counts(docs).collect())[:2] == [0, 0]
    judged = quality_rules.quality(docs, labels).collect()
    assert {r.n_words for r in judged if r.doc_id == 1} == {300_000} and all(r.base_failed for r in judged)
    assert suffix_dedup.suffix_dedup(docs).count() == n and packing.pack(docs).agg(F.sum("length")).first()[0] > n
    found = language_id.language_id(docs, docs).collect()
    assert len(found) == n and {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"xx"}
    scored = toxicity.toxicity(docs, labels, fold(5) != 0)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"] and scored.count() == n
    items = spark.createDataFrame([(1, "Plain text!", "own")], "item_id long, text string, gone string")
    assert decontaminate.decontaminate(docs, items).columns == docs.columns
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == {3, 4}
    assert near_dedup.keep_one(docs).columns == docs.columns
    assert {r.doc_id: r.group_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
