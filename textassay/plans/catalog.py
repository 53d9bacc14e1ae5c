"""All queries by name: a chain of named steps, run by Spark or rendered for the oracle."""

from __future__ import annotations

import functools
import importlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from textassay.functions.dialect import DUCK, SCANNED
from textassay.sources.shared import kept

MODULES = ("rules", "features", "paragraphs", "store", "joins", "learn", "simhash", "pages")
#: Steps that Spark writes out once and reads back: many queries filter on their columns,
#: and a filter pushed below them would repeat their large expressions.
STORED = ("scored", "fp", "near_copies", "near_before", "near_items", "judged_parts")
#: Bytes of files that a task takes of a stored table whose rows become many: it holds the distinct grams of so much text.
PARTED, PART = ("judged_parts",), 1 << 22
#: Tables with long texts, whose rows are costly to work on, and the size below which they are dealt out.
TEXTS, SMALL = ("documents", "pages"), 1 << 28
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@functools.cache
def _registry() -> tuple[dict, dict]:
    bases, queries = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"textassay.operators.{name}")
        bases |= getattr(module, "BASES", {})
        queries |= module.QUERIES
    return bases, queries


def sql(name: str, dialect) -> str:
    """WITH chain of the steps that a query needs, in order of their dependence."""
    bases, queries = _registry()
    top = name if name in STORED else None
    body = bases[name](dialect) if top else queries[name](dialect)
    chain: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z_0-9]*", text)):
            if word in bases and word not in done and not (word in STORED and word != top and dialect.name == "spark") and re.search(rf"\b(?:FROM|JOIN)\s+{word}\b|,\s*{word}\s+(?:AS\s+)?[a-z]\b", text):
                done.add(word)
                step = bases[word](dialect)
                need(step)
                chain.append(f"{word} AS ({step})")

    done: set[str] = set()
    need(body)
    return (("WITH " + ",\n".join(chain) + "\n") if chain else "") + body


def step(name: str, dialect) -> str:
    return _registry()[0][name](dialect)


def spread(rows: DataFrame) -> DataFrame:
    """Deal a small table in fewer files than cores over all cores; larger ones are split by the scan itself."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(cores) if size < SMALL and len(rows.inputFiles()) < cores else rows


def parted(rows: DataFrame) -> DataFrame:
    """A stored table in parts of PART bytes of its files, at least one a core."""
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(str(size)) // PART)))


def over(text: str, spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """A SQL text over these tables, by names that no one else's views have and that are gone afterwards."""
    tag = f"textassay_{uuid.uuid4().hex}_"
    for name, rows in tables.items():
        rows.createOrReplaceTempView(tag + name)
        text = re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2{tag}{name}", text)
    try:
        return spark.sql(text)  # names are resolved here
    finally:
        for name in tables:
            spark.catalog.dropTempView(tag + name)


def marked(documents: DataFrame) -> DataFrame:
    from textassay.operators import rules

    return rules.marked(documents.selectExpr("doc_id", "lang", "source", "coalesce(text, '') AS t"))


def run_text(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    used = lambda name: re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text)
    tables = {}
    for name in TABLES:
        if used(name):
            rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            tables[name] = spread(rows) if name in TEXTS else rows
    for name in STORED:
        if used(name):
            tables[name] = kept(spark, sf_dir, name, lambda name=name: MAKERS[name](spark, sf_dir))
            if name in PARTED:
                tables[name] = parted(tables[name])
    if used("marked"):
        tables["marked"] = marked(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return over(text, spark, tables)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_text(sql(name, SCANNED), spark, sf_dir)


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textassay.operators.simhash import fingerprints

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return fingerprints(docs.selectExpr("doc_id", "'document' AS kind", "text").unionByName(items.selectExpr("item_id AS doc_id", "'item' AS kind", "text")))


def _pairs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from textassay.operators.simhash import stored_pairs

    return stored_pairs(spark, sf_dir, name)


MAKERS = {"scored": functools.partial(run, "scored"), "judged_parts": functools.partial(run, "judged_parts"), "fp": _fingerprints} | {name: functools.partial(_pairs, name=name) for name in ("near_copies", "near_before", "near_items")}


def sql_queries() -> dict:
    return {name: functools.partial(run, name) for name in _registry()[1]}


def sql_oracles() -> dict[str, str]:
    return {name: sql(name, DUCK) for name in _registry()[1]}
