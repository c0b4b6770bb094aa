"""Token alignment against whole texts encoded by each library and links found pair by pair."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weekloom.llm import alignment
from weekloom.llm.pretokens import byte_letters, default_path
from weekloom.llm.queries import QUERIES

TEXTS = [
    None, "", " ", "\n", "  ", "a", "a ", " a", "a  b", "a \n b", "\n\na", "a\n", "one two three one two three", "it's don't 'll we're",
    "tab\there \t there", "nbsp\xa0 x \xa0", "em  space", "line sep", "carriage\r\nreturn", "low▁line", "▁", "a ▁ b", "☃ ☃☃", "漢字かな交じり文", "naïve é́", "\x00 nul \x01",
    "<|endoftext|> is text", "<s> </s> <unk> <0x0A>", "12345 67.89", "emoji 👩‍👩‍👧‍👦 family", "x" * 3000, "word " * 2000, "ünï cödé   spaces    many", "zero​width", "next\x85line", "﻿bom", "a᠎b", "unit\x1f \x1cfile",
]


def links_of(a, b):
    out, ends = [], []
    for ids in (a, b):
        at, own = 0, []
        for i, raw in ids:
            own.append((at, at + len(raw), i))
            at += len(raw)
        ends.append(own)
    pairs = [(x[2], y[2]) for x in ends[0] for y in ends[1] if x[0] < y[1] and y[0] < x[1]] if len(ends[0]) * len(ends[1]) < 200_000 else None
    if pairs is None:
        pairs = [(x[2], y[2]) for x in ends[0] for y in ends[1][max(0, np.searchsorted([e[1] for e in ends[1]], x[0]) - 1) :][:60] if x[0] < y[1] and y[0] < x[1]]
    cuts = sorted({x[1] for x in ends[0]} & {x[1] for x in ends[1]})
    groups, lo = [], 0
    for hi in cuts:
        groups.append("|".join(",".join(str(x[2]) for x in own if lo < x[1] <= hi) for own in ends))
        lo = hi
    return pairs, groups


def brute(docs):
    """By the libraries on whole texts."""
    a = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    back = {c: i for i, c in enumerate(byte_letters())}
    per = []
    for i, text in docs:
        x = y = ()
        if text:
            x = [(k, bytes(back[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
            if any(b"".join(r for _, r in side) != (" " + text).encode() for side in (x, y)):
                x = y = ()
        per.append((i, x, y, *links_of(x, y)))
    count = Counter(p for row in per for p in row[3])
    most = defaultdict(int)
    for (_, k), n in count.items():
        most[k] = max(most[k], n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(i, len(x), len(y), len(groups), len(pairs), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), digest(groups), ";".join(groups)) for i, x, y, pairs, groups in per]


@pytest.mark.parametrize("block", [1, 3000, 1 << 24])
def test_whole_texts(spark, block):
    rng = random.Random(3)
    docs = list(enumerate(TEXTS * 2)) + [(5, "another text of a repeated id"), (None, "no id")]
    docs += [(1000 + i, "".join(rng.choice(["the ", "Straße", "\n", " ", "  ", "é", "lo", "rem", ".", "1", "漢", "'s", "ation "]) for _ in range(rng.randint(1, 80)))) for i in range(150)]
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, n_a int, block string, pair int").repartition(5)
    found = alignment.cross_alignment(frame, block_bytes=block)
    got = sorted([tuple(r) for r in found.collect()], key=str)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert got == sorted(brute(docs), key=str)


def test_empty_table(spark):
    assert alignment.cross_alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_coalesce():
    """Intervals with gaps, against all pairs."""
    rng = random.Random(5)
    for _ in range(200):
        sides = []
        for _ in range(2):
            at, own = 0, []
            for _ in range(rng.randint(0, 12)):
                at += rng.choice([0, 0, 1, 3])
                own.append((at, at := at + rng.randint(1, 4)))
            sides.append(np.array(own, np.int64).reshape(-1, 2))
        a, b = sides
        got = alignment.coalesce(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i, 0] < b[j, 1] and b[j, 0] < a[i, 1]]
        assert list(zip(got.link_a.tolist(), got.link_b.tolist(), strict=True)) == want
        parent = list(range(len(a) + len(b)))
        root = lambda k: k if parent[k] == k else root(parent[k])  # noqa: B023, E731
        for i, j in want:
            parent[root(i)] = root(len(a) + j)
        groups = np.concatenate([got.group_a, got.group_b])
        assert all((groups[i] == groups[j]) == (root(i) == root(j)) for i in range(len(parent)) for j in range(len(parent)))


def test_query(spark, tmp_path):
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_token_alignment"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(r[:8] for r in brute([r[:2] for r in docs]))
