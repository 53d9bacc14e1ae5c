"""Grams of judged documents: parts of bounded size, and no join of grams with judgements."""

from textassay.functions.dialect import SCANNED
from textassay.plans import catalog


def test_texts_of_grams_are_read_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("sha2(CAST(id AS STRING), 256) AS t").coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(catalog, "PART", 1 << 16)
    assert catalog.parted(rows).rdd.getNumPartitions() >= 10
    assert catalog.parted(rows).count() == 20_000


def test_grams_are_not_joined_with_their_judgements():
    for name in ("suggest_keywords", "suggest_removals"):
        text = catalog.sql(name, SCANNED)
        assert "JOIN" not in text and "judged_parts" in text


def test_a_document_judged_twice_counts_as_in_the_join(spark):
    """Each of two judgements has the grams, and each meets both judgements."""
    rows = spark.createDataFrame([(1, 0, "junk", "ok", "once upon"), (1, 0, "junk", "ok", "once upon"), (2, 0, "junk", "junk", "other")], "doc_id long, quality int, verdict string, scale string, t string")
    parts = catalog.over(catalog.step("judged_parts", SCANNED), spark, {"judged": rows})
    found = catalog.over(catalog.sql("suggest_keywords", SCANNED), spark, {"judged_parts": parts})
    assert sorted(map(tuple, found.collect())) == [("once", 4), ("once upon", 4), ("upon", 4)]
