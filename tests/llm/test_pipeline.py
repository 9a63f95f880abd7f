"""The pipeline's stages against brute force, each on its own input."""

import re

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from gridlark.llm.secret_scan import MARK
from tests.llm.test_dedup import slow_removal
from tests.llm.test_native import base, secret_base
from tests.llm.test_near_copies import slow_components

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    by_stage = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        path = str(tmp_path / str(k))
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        by_stage.append((name, before, docs.collect()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    names = [n for n, _, _ in by_stage]
    assert names == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "secret_scan", "best_fit_packing"]

    _, before, after = by_stage[0]
    kept = {r["doc_id"] for r in after}
    assert not kept & {k for k, r in before.items() if base(r["text"])[5]}
    good = {k for k, q in labels.items() if q == 1 and k in before and not base(before[k]["text"])[5]}
    assert len(good & kept) >= 0.95 * len(good)

    _, before, after = by_stage[1]
    expected = slow_components({k: r["text"] for k, r in before.items()})
    assert {r["doc_id"] for r in after} == set(expected.values())

    _, before, after = by_stage[2]
    ids = sorted(before)
    left = dict(zip(ids, (e[3].decode(errors="ignore") for e in slow_removal([before[k]["text"] for k in ids], 200)), strict=True))
    assert {r["doc_id"]: r["text"] for r in after} == {k: t for k, t in left.items() if re.search(r"[^\x20\x09-\x0D]", t)}
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    _, before, after = by_stage[3]
    assert set(before) == {r["doc_id"] for r in after}
    for r in after:
        if secret_base(before[r["doc_id"]]["text"]):
            assert MARK in r["text"] and not secret_base(r["text"].replace(MARK, " "))
        elif MARK not in r["text"]:
            assert r["text"] == before[r["doc_id"]]["text"]

    _, before, after = by_stage[4]
    assert {r["doc_id"] for r in after} == set(before)
    assert len({r["sequence_id"] for r in after}) <= -(-sum(r["length"] for r in after) // 2048) * 1.05 + 1


def test_run(spark):
    rows = corpus_pipeline.run(spark, DIR)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns)
    ends = np.array([r["offset"] + r["length"] for r in rows.collect()])
    assert ends.max() <= 2048 and len(ends)
    assert pq.ParquetFile(f"{DIR}/documents.parquet").metadata.num_rows >= rows.select("doc_id").distinct().count()


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and ids, and no rows at all."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    some = docs.orderBy("doc_id").limit(30)
    rows = [tuple(r) for r in some.collect()]
    odd = [(None, rows[0][1], None, None, None), (None, None, "en", None, 0), (900, None, None, "s", None), (901, "", "en", "s", 0), rows[3], (rows[4][0], rows[5][1], "en", "s", 1)]
    for name, table in (("odd", spark.createDataFrame(rows + odd, docs.schema)), ("none", docs.limit(0))):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{k}")
            stage(spark, now, DIR).write.parquet(path)
            now = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == corpus_pipeline.COLUMNS
        assert (now.count() == 0) == (name == "none")
