"""Aligning the tokens that two tokenizers cut from the same texts.

Both token lists of a text are intervals of its bytes.  *Interval coalescing*: all intervals are sorted by their start, and
a group ends where a start reaches the running maximum of the ends; within a group the overlapping pairs are expanded.
How often an id pair is linked is counted over the whole corpus, and each document's links are then judged by those counts.

Neither vocabulary has a token that goes on from another character to a space or to a line feed (this is looked up when the vocabulary is
loaded), so a text is cut there into *segments*, and the tokens, groups and links of a segment need to be found once
while a task remembers it.  A text with other white space, or of other vocabularies, is one segment.

Counts reach the documents without a broadcast.  Documents are taken in *blocks* of bounded size; a block sends its distinct pairs, summed,
to be added up by pair, and gets the totals of these pairs back, so what is shuffled are distinct pairs of blocks and not links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.pretokens import byte_letters, default_path, tokenizer
from weekloom.llm.textops import Scratch, ship, small, text_of

BLOCK_BYTES = 8 << 20
REMEMBERED = 200_000
REMEMBERED_BYTES = 32 << 20
_SEGMENTS = re.compile("[ \n]+[^ \n]*").findall
#: White space on which the vocabularies' rules, Unicode and ``re`` may differ.
_ODD_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]").search


class Coalesced(NamedTuple):
    """The group of each A and each B interval, and the links as positions in both lists."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> Coalesced:
    """Groups and overlapping pairs of two lists of non-empty intervals; each list is sorted and free of overlaps.

    Groups are numbered from 0 by their place.  Empty lists give empty results.
    """
    starts, ends = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order]) if len(order) else ends
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    first = np.searchsorted(end_b, start_a, "right")
    links = np.maximum(np.searchsorted(start_b, end_a, "left") - first, 0)
    link_a = np.repeat(np.arange(len(start_a)), links)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(links) - links, links) + first[link_a]
    return Coalesced(group[: len(start_a)], group[len(start_a) :], link_a, link_b)


class Vocabulary(NamedTuple):
    """One side: its tokenizer, the bytes of each id, and whether texts may be cut before spaces and line feeds."""

    encode: Callable[[list[str]], list[list[int]]]
    entries: list[bytes]
    lengths: np.ndarray
    cuts: bool


@lru_cache(2)
def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary of ``tokenizers``; strings of special tokens are plain text."""
    held = tokenizer(path)
    held.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_letters())}
    entries = [b""] * held.get_vocab_size()
    for name, i in held.get_vocab().items():
        entries[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()

    def encode(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in held.encode_batch_fast(texts, add_special_tokens=False)]

    usual = [x for x in entries if not _ODD_SPACE(x.decode(errors="ignore"))]
    return Vocabulary(encode, entries, np.array(list(map(len, entries)), np.int64), not any(re.search(rb"[^ \n][ \n]", x) for x in usual))


@lru_cache(2)
def pieces(path: str) -> Vocabulary:
    """A ``sentencepiece`` vocabulary; it is given texts that begin with white space, and its own space stands for a first one."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)

    def entry(i: int) -> bytes:
        piece = held.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if held.is_byte(i) else piece.replace("▁", " ").encode()

    entries = [entry(i) for i in range(held.get_piece_size())]
    names = [held.id_to_piece(i) for i in range(len(entries))]
    cuts = not any("\n" in x or re.search("[^▁]▁", x) for x in names)

    def encode(texts: list[str]) -> list[list[int]]:
        """A segment that begins with a line feed gets a space that no piece joins to it, and which is taken off; so does a lone space."""
        found = held.encode([(x if x != " " else "\n ").removeprefix(" ") for x in texts], num_threads=1)
        return [ids[2:] if x == " " else ids if x[0] == " " else ids[1:] for x, ids in zip(texts, found, strict=True)]

    return Vocabulary(encode, entries, np.array(list(map(len, entries)), np.int64), cuts)


class Segments:
    """All segments met so far, by number: how many tokens, groups and links, the groups as text, and the links' id pairs."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        self.most = max(len(a.entries), len(b.entries))
        self.words = [f"{before}{i}" for before in (",", "|", ";", "") for i in range(self.most)]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.bytes = 0
        self.groups: list[str] = []
        self.sizes = np.zeros((1024, 5), np.int64)  # A tokens, B tokens, groups, links, and whether both sides give the bytes back
        self.first = np.zeros(1025, np.int64)
        self.codes = np.zeros(4096, np.int64)

    def full(self) -> bool:
        return len(self.number) > REMEMBERED or self.bytes > REMEMBERED_BYTES

    def numbers(self, segments: list[str]) -> np.ndarray:
        number, new = self.number, []
        for x in segments:
            if x not in number:
                number[x] = len(number)
                new.append(x)
        if new:
            self._add(new)
        return np.fromiter(map(number.__getitem__, segments), np.int64, len(segments))

    def _add(self, new: list[str]) -> None:
        base = len(self.groups)
        raw = [x.encode() for x in new]
        self.bytes += sum(map(len, raw))
        both = []
        for side in (self.a, self.b):
            ids = side.encode(new)
            entries = side.entries
            good = np.fromiter((b"".join([entries[i] for i in own]) == x for own, x in zip(ids, raw, strict=True)), bool, len(raw))
            both.append((ids, good))
        valid = both[0][1] & both[1][1]
        flat, count = [], []
        for ids, _ in both:
            kept = [own if ok else [] for own, ok in zip(ids, valid.tolist(), strict=True)]
            count.append(np.fromiter(map(len, kept), np.int64, len(kept)))
            flat.append(np.fromiter((i for own in kept for i in own), np.int64, int(count[-1].sum())))
        ends = [np.cumsum(side.lengths[ids]) for side, ids in zip((self.a, self.b), flat, strict=True)]
        found = coalesce(ends[0] - self.a.lengths[flat[0]], ends[0], ends[1] - self.b.lengths[flat[1]], ends[1])
        of = [np.repeat(np.arange(len(new)), n) for n in count]
        last = np.full(len(new), -1, np.int64)
        last[of[0]] = found.group_a  # the segment's last group: later places overwrite earlier ones
        n_groups = np.where(count[0] > 0, np.diff(np.r_[-1, np.maximum.accumulate(last)]), 0) if len(new) else last
        links = np.bincount(of[0][found.link_a], minlength=len(new))
        side = np.repeat([0, 1], [len(x) for x in flat])
        group, segment, ids = np.concatenate([found.group_a, found.group_b]), np.concatenate(of), np.concatenate(flat)
        order = np.lexsort((side, group))
        side, group, segment, ids = side[order], group[order], segment[order], ids[order]
        kind = np.zeros(len(ids), np.int64)  # what stands before an id: a comma within a side, else the side's, the group's or the segment's begin
        kind[1:] = np.maximum.reduce([side[1:] != side[:-1], 2 * (group[1:] != group[:-1]), 3 * (segment[1:] != segment[:-1])])
        kind[:1] = 3
        written = list(map(self.words.__getitem__, (kind * self.most + ids).tolist()))
        stop = np.cumsum(count[0] + count[1])
        self.groups += ["".join(written[lo:hi]) for lo, hi in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
        top = base + len(new)
        while len(self.sizes) < top:
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.first = np.concatenate([self.first, np.zeros(len(self.first) - 1, np.int64)])
        self.sizes[base:top] = np.stack([count[0], count[1], n_groups, links, valid], 1)
        self.first[base + 1 : top + 1] = self.first[base] + np.cumsum(links)
        while len(self.codes) < self.first[top]:
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.codes[self.first[base] : self.first[top]] = flat[0][found.link_a] << 32 | flat[1][found.link_b]

    def links(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id pairs of the links of these segments, in turn, and how many each segment has."""
        n = self.sizes[numbers, 3]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[numbers], n)
        return self.codes[at], n


def cut(text: str, cuts: bool) -> list[str]:
    """The segments of a space and the text."""
    text = " " + text
    return _SEGMENTS(text) if cuts and not _ODD_SPACE(text) else [text]


def _block(number: int, rows: list[tuple], held: Segments, id_type: pa.DataType, groups: bool) -> list[pa.RecordBatch]:
    """Rows of a block's documents (id, segments' numbers), then one row of its segments and pairs."""
    used, local = np.unique(np.concatenate([x[1] for x in rows]) if rows else np.zeros(0, np.int64), return_inverse=True)
    codes, links = held.links(used)
    pairs, of = np.unique(codes, return_inverse=True)
    often = np.bincount(local, minlength=len(used))
    count = np.bincount(of, weights=np.repeat(often, links), minlength=len(pairs)).astype(np.int64)
    sizes, at = [], 0
    columns: dict[str, list] = {"digest": [], "groups": [], "segments": []}
    for _, mine in rows:
        sizes.append(held.sizes[mine, :4].sum(0))
        joined = ";".join(map(held.groups.__getitem__, mine.tolist()))
        columns["digest"].append(hashlib.sha256(joined.encode()).hexdigest() if len(mine) else "")
        columns["groups"].append(joined if groups else None)
        columns["segments"].append(local[at : at + len(mine)].astype("<u4").tobytes())
        at += len(mine)
    n, sizes = len(rows), np.array(sizes, np.int64).reshape(-1, 4)
    none = pa.nulls(n, pa.list_(pa.int64()))
    documents = [pa.array([number] * n, pa.int64()), pa.array([x[0] for x in rows], id_type), *(pa.array(sizes[:, k]) for k in range(4)), pa.array(columns["digest"], pa.string()), pa.array(columns["groups"], pa.string()), pa.array(columns["segments"], pa.binary()), none, none, pa.nulls(n, pa.binary())]
    table = links.astype("<u4").tobytes() + of.astype("<u4").tobytes()
    own = [pa.array([number], pa.int64()), pa.nulls(1, id_type), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([np.array([len(links)], "<u4").tobytes()], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([count], pa.list_(pa.int64())), pa.array([table], pa.binary())]
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "segments", "pairs", "counts", "links"]
    return [pa.RecordBatch.from_arrays(x, names) for x in (documents, own)]


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts of these lengths."""
    total = np.r_[0, np.cumsum(values)]
    stop = np.cumsum(lengths)
    return total[stop] - total[stop - lengths]


def _judge(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one block with the sums over their links; right has the totals of the block's pairs."""
    own = pc.is_valid(left["links"])
    block, docs = left.filter(own), left.filter(pc.invert(own))
    n = int(np.frombuffer(block["segments"][0].as_py(), "<u4")[0])
    table = np.frombuffer(block["links"][0].as_py(), "<u4").astype(np.int64)
    links, of = table[:n], table[n:]
    order = np.argsort(right["pair"].to_numpy())
    total, best = right["total"].to_numpy()[order], right["best"].to_numpy().astype(np.int64)[order]
    by_segment = [_sums(x[of], links) for x in (total, best)]
    held = [np.frombuffer(x.as_py(), "<u4") for x in docs["segments"]]
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    numbers = np.concatenate(held) if held else np.zeros(0, np.uint32)
    count_sum, n_best = (_sums(x[numbers], lengths) for x in by_segment)
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum)).append_column("groups_sha256", docs["groups_sha256"]).append_column("groups", docs["groups"])


def cross_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, groups: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are left): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 and, if asked for, groups (``a1,a2|b1;a3|b2,b3``: A and B ids of each group in order; else null).

    A is a byte-level vocabulary of ``tokenizers`` and is given a space and the text, B one of ``sentencepiece`` and is given the text.  A link is a pair of an A and a B token that share a byte;
    its count is how many links of the corpus have the same two ids; ``n_best`` counts the links that no other pair with the same B id exceeds, ties included.
    A null or empty text, and one whose bytes either side doesn't give back, has no tokens: zeros, and '' for both texts.  Repeated rows count as often as they are there,
    a null doc_id stays null, an empty table gives an empty one.
    """
    a_path, b_path = a_path or default_path("byte_bpe_50k.json"), b_path or default_path("piece_bpe_32k.model")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieces(b_path)
        held, cuts = Segments(a, b), a.cuts and b.cuts
        base, number, size, rows, id_type = TaskContext.get().partitionId() << 32, 0, 0, [], None
        for batch in small(batches):
            id_type = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                texts = text_of(part).to_pylist()
                segments = [cut(x, cuts) if x else [] for x in texts]
                numbers = held.numbers([x for own in segments for x in own])
                for doc_id, text, mine in zip(part.column(0).to_pylist(), texts, np.split(numbers, np.cumsum(list(map(len, segments)))[:-1]), strict=True):
                    rows.append((doc_id, mine if held.sizes[mine, 4].all() else mine[:0]))
                    size += len(text or "") + 64
                if size > block_bytes:
                    yield from _block(base + number, rows, held, id_type, groups)
                    number, size, rows = number + 1, 0, []
                    if held.full():
                        held.clear()
        if rows:
            yield from _block(base + number, rows, held, id_type, groups)

    id_type = docs.select("doc_id").schema[0].dataType.simpleString()
    columns = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long"
    found = scratch.put(docs.select("doc_id", "text").mapInArrow(run, f"block long, {columns}, groups_sha256 string, groups string, segments binary, pairs array<long>, counts array<long>, links binary"))
    own = scratch.put(found.where("pairs IS NOT NULL").select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n")))
    total = own.groupBy("pair").agg(F.sum("n").alias("total"))
    total = scratch.put(total.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = total.groupBy("b").agg(F.max("total").alias("most"))  # one row for each entry of B that occurs: no more than the vocabulary has
    judged = total.join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = own.join(judged.hint("merge"), "pair").select("block", "pair", "total", "best")
    out = found.drop("pairs", "counts").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_judge, f"{columns}, n_best long, count_sum long, groups_sha256 string, groups string")
    return out if groups else out.drop("groups")
