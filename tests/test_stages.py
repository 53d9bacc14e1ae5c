"""Order, halting, going on, replacing and carried data of the staged pipeline, by row and by stage."""

import pytest
from pyspark.sql import functions as F

from textassay.plans import stages


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, raw string")


def add(name):
    return lambda df: df.withColumn("seen", F.concat(F.col("seen"), F.lit(name)))


def test_stages_run_in_order(rows):
    got = stages.Pipeline().add("a", add("a")).add("b", add("b")).add("c", add("c")).run(rows.withColumn("seen", F.lit(""))).collect()
    assert {r.seen for r in got} == {"abc"} and all(r.stages == ["a", "b", "c"] and r.errors == [] and not r.halted for r in got)


def test_critical_stage_that_raises_halts_every_row(rows):
    def extract(df):
        raise ValueError("extraction failed")

    got = stages.Pipeline().add("extract", extract).add("score", add("x")).run(rows).collect()
    assert all(r.errors == ["extract: extraction failed"] and r.stages == [] and r.halted for r in got) and len(got) == 3


def test_other_stage_that_raises_is_passed(rows):
    def enrich(df):
        return df.select("no_such_column")

    got = stages.Pipeline().add("enrich", enrich).add("score", lambda df: df.withColumn("x", F.lit(1))).run(rows).collect()
    assert all(r.stages == ["score"] and len(r.errors) == 1 and r.errors[0].startswith("enrich: ") and r.x == 1 for r in got)


def test_add_remove_replace(rows):
    p = stages.Pipeline().add("a", add("a")).add("b", add("b")).add("c", add("c"))
    assert p.names == ["a", "b", "c"] and p.remove("b").names == ["a", "c"]
    assert p.replace("c", add("C")).names == ["a", "c"] and p.replace("d", add("d")).names == ["a", "c", "d"]
    assert {r.seen for r in p.run(rows.withColumn("seen", F.lit(""))).collect()} == {"aCd"}


def test_rows_with_errors_keep_what_they_had(rows):
    """A row's error undoes the stage for that row alone; later stages see what earlier ones set."""
    half = lambda df: df.withColumns({"raw": F.lit("changed"), "new": F.lit(7), "error": F.when(F.col("id") == 2, "two")})
    after = lambda df: df.withColumn("seen", F.concat_ws("-", "raw", "new"))
    got = {r.id: r for r in stages.Pipeline().add("half", half).add("after", after).run(rows).collect()}
    assert (got[1].raw, got[1].new, got[1].seen, got[1].stages) == ("changed", 7, "changed-7", ["half", "after"])
    assert (got[2].raw, got[2].new, got[2].seen, got[2].errors, got[2].stages) == ("", None, "", ["half: two"], ["after"])


def test_empty_pipeline(rows):
    got = stages.Pipeline().run(rows)
    assert got.columns == ["id", "raw", "errors", "stages", "halted"] and got.drop(*stages.OWN).collect() == rows.collect()
    assert stages.default().run(rows.limit(0).withColumn("source", F.lit("s"))).count() == 0


def test_default_pipeline(spark):
    long = "some words of a text that is long enough to be cut " * 300
    rows = spark.createDataFrame([(1, "Act now! guaranteed returns and a wire transfer", "s"), (2, "  \n", "s"), (3, None, "s"), (4, "plain words", None), (5, long, "s"), (6, long, "s")], "id int, raw string, source string")
    got = {r.id: r for r in stages.default().run(rows).collect()}
    assert [got[k].errors for k in (1, 2, 3, 4, 5)] == [[], ["extract: no content"], ["extract: no content"], ["enrich: no source"], []]
    assert got[2].halted and got[2].overall is None and got[2].stages == []
    assert got[4].stages == ["extract", "preprocess", "score", "postprocess"] and got[4].content_hash is None and got[4].verdict is not None
    assert got[5].cut and not got[1].cut and got[5].overall == got[6].overall and "scam_keywords" in got[1].matched
