"""A pipeline of named stages over a table, with errors kept by row.

A stage is a function of a DataFrame to a DataFrame.  It reports what goes wrong with a row in
a column `error` (null where nothing did): that row keeps the columns it had before the stage,
its `errors` get "name: what", and it goes on to the next stage, or, after a critical stage,
past all others.  A stage that raises when its plan is made fails for every row alike.  A stage
may add, change and drop columns and rows; `errors`, `stages` (those a row has gone through)
and `halted` are the pipeline's own.

Rows that a critical stage has failed leave the plan there: the table is written out once and
read twice, so no stage is ever planned for them, and they come back at the end with nulls in
the columns they never got.  Plans do not double with each stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.functions.dialect import SCANNED
from textassay.plans import catalog
from textassay.sources.shared import folder

Stage = Callable[[DataFrame], DataFrame]
OWN = ("errors", "stages", "halted")
#: Stages without which nothing that follows makes sense.
CRITICAL = ("extract", "score")


class Pipeline:
    def __init__(self, critical: tuple[str, ...] = CRITICAL):
        self.critical = critical
        self._stages: list[tuple[str, Stage]] = []

    def add(self, name: str, stage: Stage) -> Pipeline:
        self._stages.append((name, stage))
        return self

    def remove(self, name: str) -> Pipeline:
        self._stages = [s for s in self._stages if s[0] != name]
        return self

    def replace(self, name: str, stage: Stage) -> Pipeline:
        """In the place of every stage of that name, at the end where there is none."""
        if name not in self.names:
            return self.add(name, stage)
        self._stages = [(n, stage if n == name else s) for n, s in self._stages]
        return self

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self._stages]

    def run(self, rows: DataFrame) -> DataFrame:
        """All rows with errors and stages (arrays of texts) and halted; an empty pipeline leaves them as they are."""
        none = F.array().cast("array<string>")
        rows = rows.withColumns({"errors": none, "stages": none, "halted": F.lit(False)})
        base, aside = f"{folder(rows.sparkSession)}/pipeline-{uuid.uuid4().hex}", []
        for k, (name, stage) in enumerate(self._stages):
            rows = self._step(rows, name, stage)
            if name in self.critical:
                rows.write.parquet(f"{base}/{k}")
                rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{base}/{k}")
                aside.append(rows.where("halted"))
                rows = rows.where("NOT halted")
        for other in aside:
            rows = rows.unionByName(other, allowMissingColumns=True)
        return rows

    def _step(self, rows: DataFrame, name: str, stage: Stage) -> DataFrame:
        halts = F.lit(name in self.critical)
        try:
            given = rows.withColumn("_before", F.struct(*rows.columns)).drop(*OWN)
            done = stage(given)
            done.schema  # an unresolved column shows here, not in the middle of the job
        except Exception as e:  # whatever a stage's author let slip is an error of the stage
            said = f"{name}: {e}".split("\n")[0]
            return rows.withColumns({"errors": F.concat("errors", F.array(F.lit(said))), "halted": halts})
        fault = F.col("error").cast("string") if "error" in done.columns else F.lit(None).cast("string")
        before = {f.name: f.dataType for f in rows.schema}
        columns = [c for c in done.columns if c not in ("error", "_before")]
        kept = [F.when(fault.isNull(), F.col(c)).otherwise(F.col(f"_before.{c}") if c in before and done.schema[c].dataType == before[c] else F.lit(None)).alias(c) for c in columns]
        own = [
            F.when(fault.isNull(), F.col("_before.errors")).otherwise(F.concat(F.col("_before.errors"), F.array(F.concat(F.lit(f"{name}: "), fault)))).alias("errors"),
            F.when(fault.isNull(), F.concat(F.col("_before.stages"), F.array(F.lit(name)))).otherwise(F.col("_before.stages")).alias("stages"),
            (fault.isNotNull() & halts).alias("halted"),
        ]
        return done.select(*kept, *own)


def extract(rows: DataFrame) -> DataFrame:
    """text from raw (trimmed); blank content is an error."""
    bare = F.regexp_replace(F.coalesce("raw", F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return rows.withColumn("text", bare).withColumn("error", F.when(bare == "", "no content"))


def enrich(rows: DataFrame) -> DataFrame:
    """content_hash and n_chars; a document without a source has nothing to look up."""
    return rows.withColumns({"content_hash": F.sha2("text", 256), "n_chars": F.length("text").cast("bigint"), "error": F.when(F.col("source").isNull(), "no source")})


def preprocess(rows: DataFrame) -> DataFrame:
    """Texts over 10 000 characters are judged by their first 5000 and last 2000."""
    short = F.concat(F.substring("text", 1, 5000), F.lit("\n"), F.expr("right(text, 2000)"))
    return rows.withColumn("judged", F.when(F.length("text") > 10_000, short).otherwise(F.col("text")))


def score(rows: DataFrame) -> DataFrame:
    """overall and matched of the rule engine; rows are told by the hash of what is judged, so equal texts are scored once."""
    keyed = rows.withColumn("_key", F.sha2("judged", 256))
    texts = keyed.groupBy("_key").agg(F.first("judged").alias("text")).selectExpr("_key AS doc_id", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "text")
    scored = catalog.over(catalog.sql("scored", SCANNED), rows.sparkSession, {"marked": catalog.marked(texts)}).select(F.col("doc_id").alias("_key"), "overall", "matched")
    return keyed.join(scored.hint("merge"), "_key", "left").drop("_key").withColumn("error", F.when(F.col("overall").isNull(), "not scored"))


def postprocess(rows: DataFrame) -> DataFrame:
    """Verdict by score; what was cut for judging is marked."""
    verdict = F.when(F.col("overall") < 40, "junk").when(F.col("overall") <= 60, "suspicious").when(F.col("overall") <= 80, "normal").otherwise("quality")
    return rows.withColumns({"verdict": verdict, "cut": F.length("judged") < F.length("text")})


def default() -> Pipeline:
    """extract, enrich, preprocess, score, postprocess over rows with raw and source."""
    return Pipeline().add("extract", extract).add("enrich", enrich).add("preprocess", preprocess).add("score", score).add("postprocess", postprocess)
