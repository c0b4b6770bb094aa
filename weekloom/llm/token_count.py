"""Token counts by a linear longest-match automaton.

Greedy word pieces: each unit of a text is cut into the longest vocabulary entry, again and again from
what is left.  The automaton is the vocabulary's trie with a failure link for each node and, precomputed
with it, how many pieces following that link completes; so a unit is counted in one pass over its bytes
and no piece is ever built.  The vocabulary's path is a parameter.  A null or empty text has 0 tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from weekloom.llm.pretokens import Memo, byte_letters, default_path, units
from weekloom.llm.textops import ship, small, text_of

#: A unit's last byte is another symbol than the same byte before the end.
LAST = 256
END = "</w>"


class LongestMatch:
    """Over sequences of symbols; every single symbol that occurs has to be an entry."""

    def __init__(self, entries: list[tuple[int, ...]]):
        self.child: dict[tuple[int, int], int] = {}
        parent, symbol, whole = [-1], [-1], [False]
        for entry in entries:
            at = 0
            for s in entry:
                to = self.child.get((at, s))
                if to is None:
                    to = self.child[at, s] = len(parent)
                    parent.append(at)
                    symbol.append(s)
                    whole.append(False)
                at = to
            whole[at] = True
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        self.fail, self.popped = [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if whole[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            z, n = self.fail[parent[v]], self.popped[parent[v]]
            while z >= 0 and (z, symbol[v]) not in self.child:
                n += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.child[z, symbol[v]], n

    def count(self, symbols: list[int]) -> int:
        child, fail, popped, at, n = self.child, self.fail, self.popped, 0, 0
        for s in symbols:
            while (to := child.get((at, s))) is None:
                if at == 0:
                    raise ValueError(f"symbol {s} is not in the vocabulary")
                n += popped[at]
                at = fail[at]
            at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


@lru_cache(2)
def unit_counter(path: str) -> Memo:
    code = {c: b for b, c in enumerate(byte_letters())}
    entries = []
    with open(path, encoding="utf-8") as file:
        tokenizer = json.load(file)
    special = {x["content"] for x in tokenizer["added_tokens"]}
    for token in tokenizer["model"]["vocab"]:
        if token not in special:
            body = [code[c] for c in token.removesuffix(END)]
            entries.append((*body[:-1], body[-1] + LAST) if token.endswith(END) else tuple(body))
    automaton = LongestMatch(entries)

    def count(unit: str) -> int:
        symbols = list(unit.encode())
        symbols[-1] += LAST
        return automaton.count(symbols)

    return Memo(count)


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_units long, n_tokens long: one row per document; rows that repeat are each counted."""
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = unit_counter(path).__getitem__
        for batch in small(batches):
            found, total = [], []
            for text in text_of(batch):
                cut = units(text.as_py() or "")
                found.append(len(cut))
                total.append(sum(map(of, cut)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), pa.array(total, pa.int64())], ["doc_id", "n_units", "n_tokens"])

    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_units long, n_tokens long")
