"""Files of every format, written and read back, as batch and as stream."""

import datetime
import json

import pytest

from textassay.sources import content_files


def rows(df):
    return sorted(((r.input_type, r.url, r.text, r.title, r.error) for r in df.collect()), key=repr)


def test_json_lines(spark, tmp_path):
    lines = [json.dumps({"url": " https://a.b/c ", "text": "beside", "title": "T"}), json.dumps({"text": "only text", "more": {"x": [1]}}), "", "  ", "{broken", "[1, 2]", json.dumps({"title": "none"}), json.dumps({"text": "two\nlines"})]
    (tmp_path / "in.jsonl").write_text("\n".join(lines), encoding="utf-8")
    assert rows(content_files.read(spark, f"{tmp_path}/in.jsonl")) == sorted([("url", "https://a.b/c", None, "T", None), ("text", None, "only text", None, None), (None, None, None, None, "no JSON object"), (None, None, None, None, "no JSON object"), (None, None, None, "none", "neither url nor text"), ("text", None, "two\nlines", None, None)], key=repr)


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text('Title,TEXT,URL,extra\nA,"some, ""quoted""\ntext",,1\nB,x,http://u,2\n,,,3\n', encoding="utf-8")
    got = rows(content_files.read(spark, f"{tmp_path}/in.csv"))
    assert got == sorted([("text", None, 'some, "quoted"\ntext', "A", None), ("url", "http://u", None, "B", None), (None, None, None, None, "neither url nor text")], key=repr)


def test_plain_lines(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# comment\n\n  https://a/b  \n   # another\nA text of its own\nhttp://c\n", encoding="utf-8")
    assert rows(content_files.read(spark, f"{tmp_path}/list.txt")) == sorted([("url", "https://a/b", None, None, None), ("text", None, "A text of its own", None, None), ("url", "http://c", None, None, None)], key=repr)
    with pytest.raises(ValueError, match="ends in one of"):
        content_files.read(spark, "x.pdf")


def test_feed_counts_a_link_once(spark, tmp_path):
    at = lambda h: (datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)).isoformat()
    items = [{"url": f"https://s/{k % 5}", "title": f"t{k}", "published": at(k)} for k in range(20)] + [{"title": "no link", "published": at(3)}, {"url": "https://s/none"}]
    (tmp_path / "feed").mkdir()
    for part in (items[:12], items[12:]):
        (tmp_path / "feed" / f"{len(part)}.jsonl").write_text("\n".join(map(json.dumps, part)), encoding="utf-8")
        query = content_files.feed(spark, f"{tmp_path}/feed").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.link for r in got) == [f"https://s/{k}" for k in range(5)]


@pytest.mark.parametrize("kind", ["json", "csv", "tsv"])
def test_verdicts_written_and_read_back(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'a "quoted", verdict'), (2, None)], "id int, verdict string")
    content_files.write(df, f"{tmp_path}/out", kind)
    if kind == "json":
        assert sorted((r.id, r.verdict) for r in spark.read.json(f"{tmp_path}/out").collect()) == [(1, 'a "quoted", verdict'), (2, None)]
    elif kind == "csv":
        assert sorted((r.id, r.verdict) for r in spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out").collect()) == [("1", 'a "quoted", verdict'), ("2", None)]
    else:
        assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['1\ta "quoted", verdict', "2\t"]
