"""Cases in which rows share an id, ids lie at the ends of their type, hashes are put to the test, and names are very long."""

import random
import time

import duckdb
import numpy as np

from tests.llm import brute
from weekloom.llm import line_dedup, near_dedup, quality_rules, suffix_dedup, url_filter
from weekloom.llm.queries import URL_RULES
from weekloom.llm.textops import Chunk, Hasher


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    shared, other, third = prose(1, 40), prose(2, 50), prose(3, 60)
    rows = [(1, shared), (2, shared + " tail"), (2, other), (2, shared + " tail"), (3, other + third), (3, third), (3, None), (4, third * 2)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = {}
    for i, text in rows:
        body = (text or "").encode()
        for k in range(len(body) - 49):
            seen[body[k : k + 50]] = min(i, seen.get(body[k : k + 50], i))
    want = []
    for i, text in rows:
        body = (text or "").encode()
        gone = {k + j for k in range(len(body) - 49) if seen[body[k : k + 50]] < i for j in range(50)}
        spans = sum(k in gone and k - 1 not in gone for k in range(len(body)))
        want.append((i, len(body), len(gone), spans, bytes(b for k, b in enumerate(body) if k not in gone)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)
    assert next(r for r in got if r.n_bytes == len(other)).n_removed == 0


def test_near_duplicates_hold_the_links_of_all_texts(spark):
    a, b, c = prose(4, 120).split(), prose(5, 120).split(), prose(6, 120)
    near = lambda words: " ".join([*words[:60], "changed", *words[61:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (3, near(b)), (4, c), (5, c), (5, None), (6, "few words"), (6, c), (None, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(frame).collect()}
    assert got == {1: (1, 1, 2), 2: (2, 1, 1), 3: (3, 1, 1), 4: (4, 4, 0), 5: (4, 4, 0), 6: (4, 4, 0)}
    # texts that are equal rows count a link once
    plain = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(a)), (2, near(a))], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(plain).collect())) == [(1, 1, 1, 1), (2, 2, 1, 1)]


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_hashes_of_plain_lines_differ():
    """Any polynomial modulo 2**64 gives these two lines one hash."""
    one, two = thue_morse(2048)
    docs = [(1, one + "\n" + two), (2, one + "\n" + two + "\n" + one)]
    counts = quality_rules.counted(Chunk(0, [t.encode() for _, t in docs]))
    assert counts[:, 3].tolist() == [0, 1] == [brute.base_rules(t)[3] for _, t in docs]


def test_hasher_against_bytes():
    rng = np.random.default_rng(3)
    buf = rng.integers(0, 3, 30_000).astype(np.uint8)
    starts = rng.integers(0, 29_000, 20_000)
    ends = starts + rng.integers(1, 8, 20_000)
    held = {}
    for a, b, h in zip(starts, ends, Hasher(buf)(starts, ends), strict=True):
        held.setdefault(buf[a:b].tobytes(), set()).add(int(h))
    assert all(len(x) == 1 for x in held.values()) and len({next(iter(x)) for x in held.values()}) == len(held)
    assert (Hasher(buf).windows(9)[:29_000] == Hasher(buf)(np.arange(29_000), np.arange(29_000) + 9)).all()


def test_line_dedup_at_the_ends_of_ids(spark):
    line = "a line of more than twenty characters"
    for ids in ([-5, 7, 2**63 - 1], [-(2**63), -(2**63) + 1, 2**63 - 1, 0], [5, 5, 5, 5], [1, 2, 3, 10**17]):
        docs = [(i, f"{line}\nown {k} {i} and further words") for k, i in enumerate(ids)]
        got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        holders = set(ids)
        want = [(i, int(len(holders) >= 3 and i < max(ids))) for i in ids]
        assert sorted((r.doc_id, r.n_dropped) for r in got) == sorted(want)


def test_very_long_hosts(spark):
    """In time, and cut as by a plain search."""
    words = ["data", "base", "database", "web", "site", "lo", "rem", "an", "a" * 63]
    docs = spark.createDataFrame([(1, " ".join(words * 20) + " an" * 50)], "doc_id long, text string")
    rng = random.Random(1)
    name = "".join(rng.choice(words[:8]) for _ in range(8000)) + "a" * 300
    short = "databasewebsiteloremqx"
    urls = [(1, f"http://{name}.com/x"), (2, f"https://{short}.org/en/1"), (3, None), (4, "http://" + "a" * 40_000 + ".example.net/de/8")]
    began = time.time()
    got = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(urls, "page_id long, url string"), docs, URL_RULES).collect()}
    assert time.time() - began < 90
    count = {w: 20 for w in words} | {"an": 70}
    for page, host in ((1, name), (2, short)):
        cutter = url_filter.Segmenter(sum(count.values()))
        known = [(i, len(w), n) for w, n in count.items() for i in range(len(host)) if host.startswith(w, i)]
        found = [w.removeprefix("h:") for w in got[page].words if w.startswith("h:")]
        want = cutter.cut(host, known)
        assert found[: len(want)] == want
    assert got[3].host == "" and got[4].verdict in ("allow", "block")


def test_op7_sql_still_agrees(spark, tmp_path):
    from weekloom.llm.queries import ORACLE, QUERIES

    docs = [(i, prose(i % 3, 60) + prose(100 + i, 20), "en", "s", 1) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op5_line_dedup", "op7_suffix_array_dedup"):
        got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.execute(ORACLE[name]).fetchall())
