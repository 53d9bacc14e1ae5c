"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs.  All stages but the last return the columns of
documents.

Defined cases: a row is told by its id (a missing one too) and its text, so texts under one
id are judged each; of rows that repeat both, one stays in the second stage.  Null and empty
texts fail the base rules, so they go in the first stage; given to a later one, they link
with nothing, hold no benchmark window, are never taken by the mix, and get a shard.  Very
long texts are read whole; empty tables give empty results; further columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.llm import decontaminate, jaccard, mixing, quality, sharding
from textassay.llm.io import free, stored, table

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are judged poor."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    kept = free("kept", docs.columns)
    return quality.score(docs, model).where(f"`{kept}`").select(*_own(docs))


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _key(docs: DataFrame) -> list:
    """What tells a row: its id and a hash of its text, neither of them null."""
    return [F.coalesce(F.hex(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit("-")).alias("_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_text")]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key stands in gone(_id, _text)."""
    named = dict(zip(("_id", "_text"), _key(docs), strict=True))
    return docs.join(gone, (named["_id"] == gone["_id"]) & (named["_text"] == gone["_text"]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-copies the document with the smallest id."""
    keyed = docs.select("doc_id", "text", *_key(docs))
    found = jaccard.join(keyed, keep=("_id", "_text"))
    # a part is a component, or a set without words, which is alone
    rows = found.groupBy("_id", "_text").agg(F.min("doc_id").alias("doc_id"), F.min("part").alias("part"), F.count("*").alias("rows"))
    rows = stored(rows, "rows")
    first = rows.where("part IS NOT NULL").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_id", "_text")).alias("o"))
    first = first.select("part", F.col("o._id").alias("kept_id"), F.col("o._text").alias("kept_text"))
    # written out, so that the joins below know their true sizes
    gone = rows.join(first.hint("merge"), "part").where("_id != kept_id OR _text != kept_text").select("_id", "_text")
    left = _without(docs, stored(gone, "copies"))
    again = stored(rows.where("rows > 1").select("_id", "_text"), "repeats")
    if again.isEmpty():
        return left.select(*_own(docs))
    # of repeated rows the smallest stays
    named = dict(zip(("_id", "_text"), _key(docs), strict=True))
    own = F.struct(*_own(docs)).alias("own")
    repeats = left.select(own, *named.values()).join(again, ["_id", "_text"], "left_semi").groupBy("_id", "_text").agg(F.min("own").alias("own"))
    return _without(left, again).select(*_own(docs)).unionByName(repeats.select("own.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    key = F.struct(*_key(docs)).alias("doc_id")
    found = decontaminate.contamination(docs.select(key, "text"), table(spark, sf_dir, "benchmark"))
    gone = stored(found.where("contaminated").select("doc_id.*").distinct(), "contaminated")
    return _without(docs, gone).select(*_own(docs))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target weights."""
    mixed = mixing.mix(docs, F.array("source"), carry=tuple(docs.columns))
    copies = mixed.where("passes > 0").select("carry", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    return copies.select(*(F.col(f"carry.`{c}`") for c in docs.columns))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; equal texts share a shard."""
    return sharding.shard(docs.select("doc_id", "text"), 40)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
    ("sharding", shards),
]

#: Learned quality, similarity components and heaps are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
