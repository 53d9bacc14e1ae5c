"""Every query with an oracle gives what DuckDB gives on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from textassay.functions.dialect import DUCK
from textassay.plans import catalog, native

ORACLES = catalog.sql_oracles() | native.ORACLES
QUERIES = catalog.sql_queries() | native.QUERIES


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(norm, v))
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6) + 0.0
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_every_query_of_the_catalog_renders_for_both_dialects():
    for name in catalog.sql_queries():
        assert catalog.sql(name, DUCK)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_oracle_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_simple_extraction_keeps_what_follows_a_header(duck):
    c = duckdb.connect()
    page = "<head><title>t</title></head><header class='h'>Top</header><article>Real text</article><style>b{}</style><script>x</script >after"
    c.execute("CREATE TABLE pages AS SELECT 1 AS page_id, 'u' AS url, ? AS html", [page])
    assert c.execute(catalog.sql("page_extract_simple", DUCK)).fetchall() == [(1, "Top Real text after")]


def test_judge_rejects_replies_with_every_dimension_at_an_end(spark, sf_dir):
    rows = QUERIES["judge_validate"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows if r.rejected} == {r.doc_id for r in rows if r.doc_id % 13 in (0, 1, 2) and r.doc_id % 5 != 1}
    assert all(r.conf == 0.1 and r.scam == r.originality == 50.0 for r in rows if r.rejected)


def test_judge_merge_takes_the_surer_reply_and_adds_costs(spark, sf_dir):
    rows = QUERIES["judge_merge"](spark, sf_dir).collect()
    for r in rows:
        first = 0.1 if r.doc_id % 5 == 1 else (r.doc_id % 10) / 10
        second = ((r.doc_id * 3 + 4) % 10) / 10
        if r.scam_source != "rules":
            assert (r.scam_source == "fallback") == (first < 0.7 and second > first)
            assert r.cost == pytest.approx(0.011 if r.scam_source == "fallback" else 0.001)
    assert {r.scam_source for r in rows} >= {"judge", "fallback"}


def test_features_keep_documents_without_text(spark, sf_dir):
    assert QUERIES["text_features"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
