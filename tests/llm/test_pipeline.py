"""The pipeline against its parts, on the smallest tables."""

import hashlib

import pytest

from tests.llm import brute
from weekloom.llm import near_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = near_dedup.Scratch(spark).put(stage(spark, docs, SF))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(seen[-1])
            break
        assert out.columns == columns
        docs = out
        seen.append({r.doc_id: r.text for r in out.collect()})
    first, tox, lines, near, clean = seen
    assert set(first) >= set(tox) == set(lines) >= set(near) >= set(clean)
    assert {i: x[2] for i, x in brute.line_dedup(list(tox.items())).items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in lines.items()}
    groups = brute.near_groups(list(lines.items()))
    assert set(near) == {i for i, g in groups.items() if i == g}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(clean)


@pytest.mark.parametrize("name", ["op5_line_dedup", "op7_suffix_array_dedup"])
def test_oracle_is_registered(name):
    from weekloom.llm.queries import ORACLE, QUERIES

    assert name in ORACLE and name in QUERIES


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "no id, but some words of its own"), (3, None), (3, "again and again"), (3, "again and again"), (4, ""), (5, "a line that is found in several documents\nown"), (6, "a line that is found in several documents"), (7, "A LINE that is found in several documents \n\n"), (8, "word " * 40_000), (9, "x" * 300_000)]])
def test_stages_on_awkward_rows(spark, tmp_path, rows):
    """Empty tables; null and repeated ids, null, empty and very long texts: every stage runs, and what it keeps is as stated."""
    import corpus_pipeline

    root = f"file://{tmp_path}"
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "again and again"), (None, "own"), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{root}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = near_dedup.Scratch(spark).put(stage(spark, docs, root))
        kept.append(sorted((r.doc_id or 0, r.text or "") for r in docs.collect()))
    tox, lines, near, clean = kept
    assert len(tox) == len(lines) == len(rows)
    if rows:
        assert [t for i, t in lines if i in (5, 6, 7)] == ["own", "", "A LINE that is found in several documents \n\n"]
        # rows with a null doc_id stay; a doc_id's rows stay or go together
        assert sorted(i for i, _ in near) == sorted(i for i, _ in lines)
        assert sorted(i for i, _ in clean) == sorted(i for i, _ in near if i != 3) + [3] or sorted(i for i, t in clean if i == 3) == [3]
        assert all(t != "again and again" for _, t in clean)
    packed = corpus_pipeline.pack(spark, docs, root).collect()
    assert len({(r.doc_id, r.doc_tokens) for r in packed}) <= len(clean) and all(r.length > 0 for r in packed)
