"""The pipeline, each stage against a plain version on what the stage before it kept."""

from __future__ import annotations

import brute
from test_documents import ODD, check_packing, lines_left, token_ids  # noqa: F401

import corpus_pipeline
from rulewright.llm.common import stored

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, documents, token_ids):  # noqa: F811
    odd = spark.createDataFrame([(i, t, None, None, -1) for i, t in ODD], documents.schema)
    docs = stored(documents.union(odd).selectExpr("*", "1 AS key", "'x' AS __gone"), "docs")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stored(stage(spark, docs, SMALL), "stage")
        if name == "packing":
            check_packing(docs.collect(), before, token_ids)
            continue
        assert docs.columns == columns
        after = [(r.doc_id, r.text) for r in docs.collect()]
        seen[name] = (before, after)
        if name != "line dedup":
            assert set(after) <= set(before)
    before, after = seen["line dedup"]
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((i, digest(t)) for i, t in after), key=str) == sorted(((i, h) for i, _, _, h in lines_left(before)), key=str)
    before, after = seen["near copies"]
    gone = {i for i, _, c in brute.near_copies(before) if i is not None and i != c}
    assert sorted(after, key=str) == sorted((r for r in before if r[0] not in gone), key=str)
    before, after = seen["decontamination"]
    items = [brute.shingles(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    sets = {}
    for i, t in before:
        sets.setdefault(i, set()).update(brute.shingles(t))
    bad = {i for i, s in sets.items() if any(k and len(k & s) >= 0.8 * len(k) for k in items)}
    assert sorted(after, key=str) == sorted((r for r in before if r[0] not in bad), key=str)
    assert all(seen[n][1] and len(seen[n][1]) < len(seen[n][0]) for n in ("quality", "near copies", "decontamination"))


def test_nothing_in_nothing_out(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), "none")
    assert docs.count() == 0
