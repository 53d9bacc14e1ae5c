"""Rule files: loading, faults, platforms; streams that go on from a base folder."""

import json

import pytest

from textassay.functions.packs import LATIN
from textassay.sources import rules_file
from textassay.streaming import jobs

RULES = {
    "rules": [
        {"name": "bait", "keywords": ["wow", "omg"], "dimension": "emo", "contribution": 40, "confidence": 0.6, "min_hits": 2},
        {"name": "local", "keywords": ["fee"], "patterns": ["pay [0-9]+", "(broken"], "dimension": "scam", "contribution": 30, "platform": "shop"},
        {"name": "", "keywords": ["x"]},
        {"name": "far", "keywords": ["x"], "contribution": 400, "dimension": "mood"},
        "no mapping",
    ]
}


@pytest.mark.parametrize("ending", ["json", "yaml"])
def test_rules_are_read_checked_and_applied(spark, tmp_path, ending):
    path = tmp_path / f"rules.{ending}"
    path.write_text(json.dumps(RULES))  # JSON is YAML too
    custom = rules_file.load_rules(spark, str(path))
    assert [r.name for r in custom] == ["custom_bait", "custom_local"] and custom[1].patterns == ("pay [0-9]+",)
    assert {(r.rule, r.error.split(" is ")[0]) for r in rules_file.validate_rules(spark, str(path)).collect()} == {(3, "name"), (4, "contribution"), (4, "dimension"), (5, "a rule")}
    docs = spark.createDataFrame([(1, "en", "shop", "a fee: pay 5"), (2, "en", "blog", "a fee: pay 5"), (3, "en", None, "wow omg"), (4, "en", "shop", "wow"), (5, None, None, None)], "doc_id long, lang string, source string, text string")
    got = {r.doc_id: (r.matched, r.scam, r.emo) for r in rules_file.score_with(docs, custom).collect()}
    assert got == {1: ("custom_local", 30.0, None), 2: ("", None, None), 3: ("custom_bait", None, 40.0), 4: ("", None, None), 5: ("", None, None)}


def test_faulty_files_are_one_fault(spark, tmp_path):
    path = tmp_path / "rules.json"
    for text in ("[1]", "{", '{"rules": 3}'):
        path.write_text(text)
        assert [r.rule for r in rules_file.validate_rules(spark, str(path)).collect()] == [0]
    assert rules_file.validate_rules(spark, str(tmp_path / "none.json")).count() == 1


def test_inventory_counts_every_category(spark):
    got = {r.category: r.n for r in rules_file.rule_inventory(spark).collect()}
    assert got["scam"] == len(LATIN.scam) and got["credibility"] == sum(map(len, LATIN.credibility)) and got["custom"] == len(LATIN.custom)


def test_streams_go_on_from_their_base(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder, base = f"{tmp_path}/in", f"file://{tmp_path}/base"
    for k, part in enumerate((rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))):
        part.write.mode("append").parquet(f"{folder}/events.parquet")
        alerts = jobs.alerts(spark, folder, f"{base}/alerts")
        newest = jobs.latest_by_user(spark, folder, f"{base}/latest")
    assert alerts.count() == rows.where("value < 5").count() == jobs.alerts(spark, folder, f"{base}/alerts").count()
    want = {(r.user_id, r.event_id) for r in rows.selectExpr("user_id", "event_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn").where("rn = 1").collect()}
    assert {(r.user_id, r.event_id) for r in newest.collect()} == want
