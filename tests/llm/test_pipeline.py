"""The corpus pipeline stage by stage, and as one run."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textassay.llm.io import stored, table


def test_stages_keep_their_promises(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    marks = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stored(stage(spark, docs, sf_dir), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == columns
        if name == "quality_rules":
            kept = {r.doc_id for r in rows.collect()}
            clean = {i for i, q in marks.items() if q == 1}
            assert len(clean & kept) >= 0.85 * len(clean) and rows.count() < before
        if name == "near_duplicates":
            texts = [r.text for r in rows.collect()]
            assert len(set(texts)) == len(texts)
        if name == "benchmark_decontamination":
            words = [" ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())) for r in table(spark, sf_dir, "benchmark").collect()]
            heads = [" ".join(w.split()[:10]) for w in words if len(w.split()) >= 10]
            for r in rows.collect():
                own = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower()))
                assert not any(f" {h} " in f" {own} " for h in heads)
        docs = rows
    assert sorted(r.shard for r in docs.select("shard").distinct().collect())[0] >= 0
    assert docs.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


WORDS = [f"word{k} of the text" for k in range(40)]


@pytest.fixture
def odd_rows(spark, odd_docs):
    """odd_docs, with ids that repeat or are missing, and columns named like those that stages make."""
    text = " ".join(WORDS)
    more = [(20, text), (20, text), (20, text + " and more"), (21, text), (None, text + " or more"), (None, None), (22, "something else entirely " + " ".join(WORDS[::-1])), (22, "another text under one id " + " ".join(reversed(text.split())))]
    rows = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    clash = {c: F.lit(c) for c in ("kept", "p_good", "_id", "_text", "own", "part", "carry", "size", "node", "source")}
    return rows.select("doc_id", "text", *(v.alias(k) for k, v in clash.items()))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, sf_dir, odd_rows, k):
    name, stage = corpus_pipeline.STAGES[k]
    rows = stored(stage(spark, odd_rows, sf_dir), name)
    got = sorted(((r.doc_id, r.text) if k < 4 else r.doc_id for r in rows.collect()), key=str)
    all_rows = sorted(((r.doc_id, r.text) for r in odd_rows.collect()), key=str)
    if k < 4:
        assert rows.columns == odd_rows.columns
    if name == "quality_rules":
        assert set(got) <= set(all_rows) and all(len((t or "").split()) >= 20 for _, t in got)
    elif name == "near_duplicates":
        text = " ".join(WORDS)
        # each text without words stays; of repeated rows one; of the near copies the one with the smallest id
        assert got.count((20, text)) == 1 and (21, text) not in got and (None, text + " or more") not in got and (20, text + " and more") not in got
        assert len([g for g in got if g[0] == 22]) == 2 and len(got) == len(set(got))
        assert {g for g in set(all_rows) if not (g[1] or "").split()} <= set(got)
    elif name == "benchmark_decontamination":
        assert got == all_rows
    elif name == "mixing_sources":
        assert set(got) <= set(all_rows)
    else:
        assert len(got) == len(all_rows)


def test_a_contaminated_row_without_id_goes(spark, sf_dir):
    item = next(r.text for r in table(spark, sf_dir, "benchmark").collect() if len(r.text.split()) > 12)
    docs = spark.createDataFrame([(None, f"before {item} after"), (None, "clean text"), (5, f"before {item} after"), (5, "clean too")], "doc_id long, text string")
    got = corpus_pipeline.benchmark_decontamination(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "clean text"), (5, "clean too")]


def test_stages_on_an_empty_table(spark, sf_dir):
    empty = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stored(stage(spark, empty, sf_dir), name).count() == 0
