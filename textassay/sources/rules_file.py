"""Rules that a user writes down in a file: read, checked, counted.

A file is a mapping with a list `rules`; each rule has a name, keywords, patterns, a
target dimension and numbers within bounds.  YAML where a parser is installed, JSON
always.  A rule file is configuration, so it is read on the driver; the rules become part
of the SQL that runs over documents.
"""

from __future__ import annotations

import dataclasses
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.functions.dialect import SCANNED
from textassay.functions.packs import DIMENSIONS, LATIN, CustomRule, Pack
from textassay.operators import rules
from textassay.plans import catalog

#: Most bytes of a rule file; its rules become SQL text.
MOST_BYTES = 1 << 20
FIELDS = {f.name: f for f in dataclasses.fields(CustomRule)}
LISTS, NUMBERS = ("keywords", "patterns"), {"contribution": (0, 100), "confidence": (0, 1), "min_hits": (1, 1 << 30)}


def _parsed(spark: SparkSession, path: str):
    size, text = 0, ""
    for row in spark.read.format("binaryFile").load(path).select("length", "content").take(1):
        size, text = row.length, bytes(row.content).decode("utf-8")
    if size > MOST_BYTES:
        raise ValueError(f"a rule file has at most {MOST_BYTES} bytes")
    if not path.endswith(".json"):
        try:
            import yaml
        except ImportError:
            pass
        else:
            return yaml.safe_load(text)
    return json.loads(text)


def faults(item) -> list[str]:
    """What is wrong with one rule, by field."""
    if not isinstance(item, dict):
        return ["a rule is a mapping"]
    found = [f"unknown field {k}" for k in item if k not in FIELDS]
    if not isinstance(item.get("name"), str) or not item["name"].strip():
        found.append("name is missing")
    if item.get("dimension", "scam") not in DIMENSIONS:
        found.append(f"dimension is not one of {', '.join(DIMENSIONS)}")
    for k in LISTS:
        if not isinstance(item.get(k, []), list) or not all(isinstance(x, str) and x for x in item.get(k, [])):
            found.append(f"{k} is a list of texts")
    for k, (low, high) in NUMBERS.items():
        x = item.get(k, FIELDS[k].default)
        if isinstance(x, bool) or not isinstance(x, int if k == "min_hits" else (int, float)) or not low <= x <= high:
            found.append(f"{k} is not within {low} and {high}")
    if item.get("platform") is not None and not isinstance(item["platform"], str):
        found.append("platform is a text")
    return found


def validate_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule (from 1; 0 for the file itself), error: one row for each fault, none for a good file."""
    try:
        data = _parsed(spark, path)
    except Exception as e:  # whatever a parser or a file system says is a fault of the file
        data, rows = None, [(0, f"{type(e).__name__}: {e}")]
    else:
        good = isinstance(data, dict) and isinstance(data.get("rules"), list)
        rows = [(i, e) for i, item in enumerate(data["rules"], 1) for e in faults(item)] if good else [(0, "the file is a mapping with a list named rules")]
    return spark.createDataFrame(rows, "rule int, error string")


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def load_rules(spark: SparkSession, path: str) -> tuple[CustomRule, ...]:
    """The rules of a file; faulty ones are left out, as are patterns that do not compile."""
    data = _parsed(spark, path)
    found = data.get("rules") if isinstance(data, dict) else None
    out = []
    for item in found if isinstance(found, list) else []:
        if not faults(item):
            own = item | {"name": f"custom_{item['name']}", "keywords": tuple(item.get("keywords", ())), "patterns": tuple(p for p in item.get("patterns", ()) if _compiles(p))}
            out.append(CustomRule(**own))
    return tuple(out)


def score_with(docs: DataFrame, custom: tuple[CustomRule, ...], pack: Pack = LATIN) -> DataFrame:
    """Rule results of docs(doc_id, lang, source, text) under a pack with these custom rules.

    A rule with a platform fires only on documents whose source is that platform.
    """
    own = dataclasses.replace(pack, custom=custom)
    rows = rules.marked(docs.selectExpr("doc_id", "lang", "source", "coalesce(text, '') AS t"), own)
    steps = {"hits": rules.hits(SCANNED, own), "base_rules": rules.base_rules(SCANNED), "rules": rules.merged(SCANNED, own)}
    chain = ", ".join(f"{name} AS ({step})" for name, step in steps.items())
    return catalog.over(f"WITH {chain} SELECT * FROM rules", docs.sparkSession, {"marked": rows}).drop("t")


def rule_inventory(spark: SparkSession, pack: Pack = LATIN) -> DataFrame:
    """category, n: how many phrases and patterns each category of a pack holds."""
    groups = {"scam": pack.scam, "anxiety": pack.anxiety, "promo": pack.promo, "hedging": pack.hedging, "credibility": sum(pack.credibility, ()), "combos": pack.combos, "platforms": pack.platforms, "citing": pack.citing, "custom": pack.custom}
    rows = [(name,) for name, group in groups.items() for _ in group]
    return spark.createDataFrame(rows, "category string").groupBy("category").agg(F.count("*").alias("n"))
