"""Near-duplicate documents by BagMinHash.

A document is the bag (multiset) of its five-word shingles; two are near duplicates if the overlap of their bags,
sum of minima over sum of maxima, is at least 0.8.

*Signatures.*  The weight of a shingle is how often it occurs.  Weights are discretised in a hierarchy of levels 1, 2, 4, 8, ...; each
slice between two levels has a Poisson process of its own, seeded by shingle and slice, with the slice's width as
rate (processes of disjoint slices are independent, so that they add up to one process over all weights).  A point has a time, a register and a place within the slice; a document takes it if the place lies below the
weight.  A register's value is its earliest point.  Two documents agree in a register with a
probability equal to the weighted Jaccard similarity.  Points are made in order of time and only up to a
limit by which all registers are full with high probability, so nearly all shingles cost one comparison; a document with an
empty register is done again with a larger limit.

*Candidates.*  Registers are grouped to bands.  Documents with equal bags (by a 128-bit sum) are one class and
enter the bands once.  In a band's bucket of at most ``all_pairs`` classes every pair is a candidate; candidates whose
registers agree in less than half (six standard deviations below 0.8) are dropped, all others are verified on their whole texts.

*Large buckets.*  In a larger bucket every pair is verified too, but in blocks: its classes are dealt to parts of about
``part`` classes, and each two parts (and each part with itself) are one group, in which the overlaps of all pairs are products of
matrices of shingles.  A pair belongs to the first large bucket that it shares, so it counts once.  A group returns only
the number of links of each of its classes and the components that they make, not the links.

*Groups.*  Verified links are joined to connected components by star contraction, in Spark.

A text of fewer than five words has one shingle of all of them; a text without words (or null) is a group of its own.
Rows with a null doc_id are left out.  Rows that repeat a doc_id with another text are one document: each text is a class of its own with its own links, the document counts
the links of all of them, and its texts' groups are one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.textops import Scratch, bags, chunks, lookup, mix, shingles, ship, small, stride, text_of

WIDTH, SIMILARITY = 5, 0.8
REGISTERS, BAND = 64, 4


def _slices(hashes: np.ndarray, group: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Seed, document, rate and how much of the slice is below the weight, for each slice that a shingle reaches."""
    parts = [(hashes, group, np.ones(len(hashes)), np.ones(len(hashes)))]
    low, own = 1, np.flatnonzero(count > 1)
    while len(own):
        seed = mix(hashes[own] + stride(low))
        parts.append((seed, group[own], np.full(len(own), float(low)), np.minimum(count[own] - low, low).astype(float)))
        low *= 2
        own = own[count[own] > low]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def signatures(hashes: np.ndarray, group: np.ndarray, count: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Bags of n documents to n x registers values (unsigned 32-bit); documents without shingles get zeros."""
    values = np.zeros((n, registers), np.uint32)
    weight = np.bincount(group, count, n)
    limit = registers * (np.log(registers) + 4) / np.maximum(weight, 1)
    todo = weight > 0
    seed, of, rate, part = _slices(hashes, group, count)
    while todo.any():
        at = np.flatnonzero(todo[of])
        time = np.zeros(len(at))
        first = np.full(n * registers, np.inf)
        turn = 0
        while len(at):
            turn += 1
            draw = mix(seed[at] + stride(2 * turn))
            # comparing the draw first saves most logarithms
            late = np.exp(-np.minimum((limit[of[at]] - time) * rate[at], 700)) * 2.0**64
            keep = np.flatnonzero(draw.astype(np.float64) >= late)
            at, draw = at[keep], draw[keep]
            time = time[keep] - np.log((draw.astype(np.float64) + 0.5) * 2.0**-64) / rate[at]
            spot = mix(seed[at] + stride(2 * turn + 1))
            register = ((spot >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            place = (spot & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate[at]
            taken = place < part[at]
            np.minimum.at(first, of[at[taken]] * registers + register[taken], time[taken])
        first = first.reshape(n, registers)
        full = todo & np.isfinite(first).all(axis=1)
        values[full] = (mix(first[full].view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        todo &= ~full
        limit[todo] *= 2
    return values


def signed(docs: DataFrame, registers: int, band: int) -> DataFrame:
    """doc_id, bag (16 bytes), signature array<int> and bands array<long>; the last three are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids = batch.column(0)
            for chunk in chunks(text_of(batch)):
                n = len(chunk.texts)
                found, of = shingles(chunk, WIDTH)
                hashes, group, count = bags(found, of)
                values = signatures(hashes, group, count, n, registers)
                bag = np.zeros((n, 2), np.uint64)
                for k in (0, 1):
                    np.add.at(bag[:, k], group, mix(hashes + stride(k + 5)) * count.astype(np.uint64))
                empty = np.bincount(of, minlength=n) == 0
                keys = np.zeros((n, registers // band), np.uint64)
                for b in range(registers // band):
                    key = np.full(n, b + 1, np.uint64)
                    for k in range(b * band, (b + 1) * band):
                        key = mix(key * stride(1) + values[:, k].astype(np.uint64))
                    keys[:, b] = key
                lists = lambda x, kind, width: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.reshape(-1), kind), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays(
                    [ids[chunk.lo : chunk.hi], pa.array([None if e else x.tobytes() for x, e in zip(bag, empty, strict=True)], pa.binary()), lists(values.view(np.int32), pa.int32(), registers), lists(keys.view(np.int64), pa.int64(), registers // band)],
                    ["doc_id", "bag", "signature", "bands"],
                )

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, bag binary, signature array<int>, bands array<long>")


def overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the bags of each pair of texts."""
    out = np.zeros(len(left))
    lo, size = 0, 0
    lengths = [len(a.as_py() or b"") + len(b.as_py() or b"") for a, b in zip(left.cast(pa.binary()), right.cast(pa.binary()), strict=True)]
    for hi in range(1, len(left) + 1):
        size += lengths[hi - 1]
        if size < 1 << 20 and hi < len(left):
            continue
        keys, counts = [], []
        for side in (left, right):
            part = [shingles(c, WIDTH) for c in chunks(side[lo:hi], 1 << 40)]
            hashes, group, count = bags(*part[0])
            keys.append((mix(hashes + mix(group.astype(np.uint64) + np.uint64(1))), group))
            counts.append(count)
        total = np.bincount(keys[0][1], counts[0], hi - lo) + np.bincount(keys[1][1], counts[1], hi - lo)
        _, a, b = np.intersect1d(keys[0][0], keys[1][0], assume_unique=True, return_indices=True)
        both = np.bincount(keys[0][1][a], np.minimum(counts[0][a], counts[1][b]), hi - lo)
        out[lo:hi] = both / np.maximum(total - both, 1)
        lo, size = hi, 0
    return out


def placed(classes: DataFrame, all_pairs: int, scratch: Scratch) -> DataFrame:
    """doc_id, b, key, n, large: each class in each bucket with other classes, the bucket's size, and the class's keys of all its large buckets, by band (0 where not large)."""
    keyed = scratch.put(classes.select("doc_id", F.posexplode("bands").alias("b", "key")))
    shared = scratch.put(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = scratch.put(lookup(keyed, shared, "key"))
    scratch.drop(keyed, shared)
    own = members.where(F.col("n") > all_pairs).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "key"))).alias("own"))
    bands = classes.select("doc_id", F.size("bands").alias("bands"))
    large = own.join(bands, "doc_id").select("doc_id", F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda b: F.coalesce(F.try_element_at("own", b), F.lit(0))).alias("large"))
    return scratch.put(members.join(large, "doc_id", "left"))


def candidates(members: DataFrame, classes: DataFrame, all_pairs: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of class representatives, a < b, each once, that share small buckets only and whose registers agree at least in half."""
    small = members.where(F.col("n") <= all_pairs).groupBy("key").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))  # at most all_pairs ids
    every = small.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b")).distinct()
    large = members.select("doc_id", "large").dropDuplicates(["doc_id"])
    values = classes.select("doc_id", "signature").join(large, "doc_id")
    both = every.join(values.toDF("a", "left", "left_large").hint("merge"), "a").join(values.toDF("b", "right", "right_large").hint("merge"), "b")
    elsewhere = F.exists(F.zip_with("left_large", "right_large", lambda x, y: (x == y) & (x != 0)), lambda x: x)
    agree = F.aggregate(F.zip_with("left", "right", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.where((agree * 2 >= F.size("left")) & ~F.coalesce(elsewhere, F.lit(False))).select("a", "b")


def overlaps(texts: pa.Array, columns: int = 8192) -> np.ndarray:
    """Weighted Jaccard similarities of the bags of all pairs of texts."""
    n = len(texts)
    parts = [shingles(c, WIDTH) for c in chunks(texts, 1 << 40)]
    hashes, group, count = bags(*parts[0])
    weight = np.bincount(group, count, n)
    # the k-th occurrence of a shingle is an element of its own, so that the bags are sets
    times = np.repeat(np.arange(len(hashes)), count)
    nth = np.arange(len(times)) - np.repeat(np.cumsum(count) - count, count)
    _, element, held = np.unique(mix(hashes[times] + mix(nth.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    common = held[element] > 1
    _, element = np.unique(element[common], return_inverse=True)
    owner = group[times][common]
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    both = np.zeros((n, n))
    for lo in range(0, int(element[-1]) + 1 if len(element) else 0, columns):
        a, b = np.searchsorted(element, (lo, lo + columns))
        matrix = np.zeros((n, columns), np.float32)
        matrix[owner[a:b], element[a:b] - lo] = 1
        both += matrix @ matrix.T
    return both / np.maximum(weight[:, None] + weight[None, :] - both, 1)


def block_links(members: DataFrame, docs: DataFrame, similarity: float, all_pairs: int, part: int) -> DataFrame:
    """doc_id, root, n: for each block of a large bucket, the links that its classes have in it, and the least class they are linked with there."""
    large = members.where(F.col("n") > all_pairs).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("doc_id", "key"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = large.select("doc_id", "key", "b", "large", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(table: pa.Table) -> pa.Table:
        ids, own = table["doc_id"].to_numpy(), table["own"].to_numpy()
        band, crossed = table["b"][0].as_py(), table["i"][0].as_py() != table["j"][0].as_py()
        keys = np.array(table["large"].to_pylist(), np.int64)
        linked = overlaps(text_of(table)) >= similarity
        linked &= ids[:, None] != ids[None, :]
        if crossed:
            linked &= own[:, None] != own[None, :]
        for b in range(band):
            linked &= (keys[:, b][:, None] != keys[:, b][None, :]) | (keys[:, b] == 0)[:, None]
        # rows that repeat a doc_id are one
        nodes, of = np.unique(ids, return_inverse=True)
        if len(nodes) < len(ids):
            merged = np.zeros((len(nodes), len(nodes)), bool)
            a, b = np.nonzero(linked)
            merged[of[a], of[b]] = True
            linked = merged
        n, label = linked.sum(axis=1), np.arange(len(nodes))
        while True:
            fresh = np.minimum(label, np.where(linked, label[None, :], len(nodes)).min(axis=1))
            if (fresh == label).all():
                break
            label = fresh
        found = np.flatnonzero(n)
        return pa.table({"doc_id": nodes[found], "root": nodes[label[found]], "n": n[found].astype(np.int64)})

    held = large.join(texts.hint("merge"), "doc_id").select("key", "i", "j", "doc_id", "b", "large", "own", "text")
    return held.groupBy("key", "i", "j").applyInArrow(run, "doc_id long, root long, n long")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float, scratch: Scratch, block: int = 200) -> DataFrame:
    """a, b, similarity of those pairs that reach it.  Documents with many pairs are copied once per ``block`` of them."""
    ids = scratch.ids(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    left = texts.hint("merge").join(load, texts["doc_id"] == load["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("left"))
    salted = pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    right = salted.join(texts.withColumnRenamed("doc_id", "b").hint("merge"), "b").withColumnRenamed("text", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            value = overlap(text_of(batch, "left"), text_of(batch, "right"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], ["a", "b", "similarity"])

    both = right.hint("merge").join(left, ["a", "salt"]).select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= similarity)


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, root: the least node of each connected component, for all nodes that have a link (columns a, b)."""
    held = scratch.put(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(most_rounds):
        # large star: every larger neighbour is linked to the least of the neighbourhood
        ways = held.union(held.select("b", "a")).toDF("u", "v")
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour, and the node, are linked to the least one
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("c"))
        small = small.where("a <> c").select("a", F.col("c").alias("b")).union(least.select(F.col("m").alias("a"), "b")).distinct()
        fresh = scratch.put(small)
        scratch.drop(held)
        held, before = fresh, state
        state = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return held.select(F.col("b").alias("node"), F.col("a").alias("root")).union(held.select("a", "a").distinct())


def grouped(rows: DataFrame, same: DataFrame | None, similarity: float, registers: int, band: int, all_pairs: int, part: int) -> DataFrame:
    """doc_id, class_id, group_id, n_links for rows of which equal ids have equal texts; ``same`` (doc, doc_id) names ids that are one document."""
    scratch = Scratch(rows.sparkSession)
    every = scratch.put(signed(rows, registers, band))
    ranked = scratch.put(every.where("bag IS NOT NULL").groupBy("bag").agg(F.min("doc_id").alias("class_id")))
    of = scratch.put(lookup(every.select("doc_id", "bag"), ranked, "bag", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")))
    own = ranked.select(F.col("bag").alias("own_bag"), F.col("class_id").alias("own_id"))
    classes = every.join(own.hint("merge"), (F.col("doc_id") == F.col("own_id")) & (F.col("bag") == F.col("own_bag")))  # by doc_id too, so that no task gets all copies of one text
    classes = scratch.put(classes.select("doc_id", "signature", "bands").dropDuplicates(["doc_id"]))
    members = placed(classes, all_pairs, scratch)
    pairs = scratch.put(candidates(members, classes, all_pairs, scratch))
    links = scratch.put(verified(pairs, rows, similarity, scratch).distinct())  # equal rows make equal links
    blocks = scratch.put(block_links(members, rows, similarity, all_pairs, part))
    edges = links.select("a", "b").unionByName(blocks.select(F.col("root").alias("a"), F.col("doc_id").alias("b")))
    if same is not None:
        texts = scratch.put(same.join(of.distinct(), "doc_id").select("doc", "class_id").distinct())
        least = scratch.put(texts.groupBy("doc").agg(F.min("class_id").alias("a")))
        edges = edges.unionByName(lookup(texts, least, "doc").where("a <> class_id").select("a", F.col("class_id").alias("b")))
    roots = components(edges, scratch)
    each = links.select(F.explode(F.array("a", "b")).alias("class_id"), F.lit(1).cast("long").alias("n")).unionByName(blocks.select(F.col("doc_id").alias("class_id"), "n"))
    n = each.groupBy("class_id").agg(F.sum("n").alias("n_links"))
    found = scratch.put(roots.join(n, roots["node"] == n["class_id"], "left").select(F.col("node").alias("class_id"), "root", "n_links"))
    out = lookup(of, found, "class_id", "left")
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min(F.coalesce("root", "class_id")).alias("group_id"), F.max(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, registers: int = REGISTERS, band: int = BAND, all_pairs: int = 8, part: int = 256) -> DataFrame:
    """doc_id, class_id (least doc_id with the same bag), group_id (least doc_id of the near-duplicate group) and
    n_links (verified links of its class, or of all its classes, to other classes): one row per distinct doc_id."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    several = scratch.put(rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least"), F.max(F.xxhash64("text")).alias("most")).where("least <> most").select("doc_id"))
    if several.isEmpty():
        return grouped(rows, None, similarity, registers, band, all_pairs, part)
    # each text of such a document gets an id of its own
    marked = rows.join(scratch.ids(several).withColumn("several", F.lit(True)), "doc_id", "left")
    marked = marked.select(F.col("doc_id").alias("doc"), F.when(F.col("several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("doc_id"), "text", "several")
    same = scratch.put(marked.where("several").select("doc", "doc_id").distinct())
    found = grouped(marked.select("doc_id", "text"), same, similarity, registers, band, all_pairs, part)
    found = scratch.put(found.join(same, "doc_id", "left").select(F.coalesce("doc", "doc_id").alias("doc_id"), "class_id", "group_id", "n_links").distinct())
    for c in ("class_id", "group_id"):
        least = scratch.put(found.groupBy(c).agg(F.min("doc_id").alias("least")))
        found = scratch.put(lookup(found, least, c).withColumn(f"least_{c}", F.col("least")).drop("least"))
    return found.groupBy("doc_id").agg(F.min("least_class_id").alias("class_id"), F.min("least_group_id").alias("group_id"), F.sum("n_links").alias("n_links"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The document of least doc_id of each group, and all with a null doc_id, with all columns."""
    gone = near_duplicates(docs, **parameters).where("doc_id <> group_id").select(F.col("doc_id").alias("gone_doc"))
    gone = Scratch(docs.sparkSession).ids(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_doc"], "left_anti")
