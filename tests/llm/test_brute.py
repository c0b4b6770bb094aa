"""Whole results of operators against versions that share nothing with them."""

import json
import random

import numpy as np
from tokenizers import Tokenizer

from weekloom.llm import quality_rules, token_count, toxicity
from weekloom.llm.pretokens import byte_letters, default_path


def test_token_counts_by_the_tokenizers_own_splitter(spark):
    """Units from the tokenizer's normaliser and pre-tokeniser, cut greedily from a plain set of entries."""
    path = default_path()
    held = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        entries = set(json.load(file)["model"]["vocab"]) - {"<|startoftext|>", "<|endoftext|>"}
    letters = byte_letters()
    longest = max(map(len, entries))

    def pieces(unit):
        symbols = [letters[b] for b in unit.encode()]
        symbols[-1] += "</w>"
        at = n = 0
        while at < len(symbols):
            at = next(end for end in range(min(len(symbols), at + longest), at, -1) if "".join(symbols[at:end]) in entries)
            n += 1
        return n

    rng = random.Random(1)
    parts = ["The", "quick", "İstanbul", "naïve", "don't", "we'll", "12345", "3.14", "漢字", "…", "!!!", "\t", "\n", "  ", "é", "ǅ", "ß", "x_y", "’s", "👩‍👩‍👧", "<|endoftext|>", "antidisestablishmentarianism"]
    texts = [None, "", " ", *("".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 60))) for _ in range(80))]
    got = {r.doc_id: (r.n_units, r.n_tokens) for r in token_count.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        plain = held.normalizer.normalize_str(text or "")
        back = {c: b for b, c in enumerate(letters)}
        units = [bytes(back[c] for c in word).decode() for word, _ in held.pre_tokenizer.pre_tokenize_str(plain)]
        assert got[i] == (len(units), sum(map(pieces, units))), text


def test_binomial_tail_is_exact():
    from fractions import Fraction
    from math import comb

    for n in (1, 7, 40, 200):
        for p in (0.03, 0.5):
            for k in {0, 1, n // 3, n - 1, n}:
                q = Fraction(p)
                want = float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))
                assert abs(quality_rules.binomial_tail(k, n, p) - want) < 1e-10


def test_cutoffs_refuse_few_good_documents(spark):
    """Over many draws of labels, a certified cutoff refuses more than alpha of good documents in at most a delta of them, as its bound says."""
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(300):
        n, true = 400, 0.035  # a step that refuses slightly more than alpha must hardly ever pass
        k = int(rng.binomial(n, true))
        missed += quality_rules.binomial_tail(k, n, 0.03) <= 0.05
    assert missed / 300 < 0.05


def test_first_step_of_the_risk_goes_down_its_slope():
    """The first step of Adam is the sign of the slope, taken here by differences of the risk; where the corrected risk of the negatives is below zero, it is turned round."""
    rng = np.random.default_rng(3)
    for prior in (0.05, 0.3, 0.95):
        kind = (np.arange(60) < 25).astype(int)
        rows = [np.sort(rng.choice(8, rng.integers(1, 5), replace=False)) for _ in kind]
        densities = [rng.uniform(0, 2, len(x)) for x in rows]
        x = np.zeros((60, 17))
        for i, (own, value) in enumerate(zip(rows, densities, strict=True)):
            x[i, own], x[i, own + 8], x[i, 16] = 1, value, 1
        start = np.zeros(17)
        start[-1] = np.log(prior / (1 - prior))
        soft = lambda z: np.logaddexp(0, z)
        rest = lambda w: soft(x[kind == 0] @ w).mean() - prior * soft(x[kind == 1] @ w).mean()  # noqa: B023, E731
        risk = (lambda w: -rest(w)) if rest(start) < 0 else (lambda w: rest(w) + prior * soft(-(x[kind == 1] @ w)).mean())  # noqa: B023
        slope = np.array([(risk(start + 1e-6 * e) - risk(start - 1e-6 * e)) / 2e-6 for e in np.eye(17)])
        moved = toxicity.nnpu(kind, rows, densities, 8, prior, rounds=1, rate=0.01) - start
        clear = np.abs(slope) > 1e-5
        assert clear.sum() > 8 and (np.sign(moved[clear]) == -np.sign(slope[clear])).all()
