"""Structured Streaming jobs over event and document files.

Each job runs what is there (availableNow) and returns the table that it has kept up.  A
job called with the base folder of an earlier call goes on from its checkpoint and table;
without one it starts anew in the shared folder.  Batches are written under their number,
so a batch that is run again replaces its own rows.  Late data: ten minutes of watermark
where a watermark bounds state.  Operators with a state a key are in ``stateful``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.functions.dialect import SCANNED
from textassay.operators import pages
from textassay.plans import catalog
from textassay.sources import score_store
from textassay.sources.shared import folder
from textassay.streaming import stateful

#: Input of a trigger, in bytes of files; a trigger takes one file at least.
TRIGGER_BYTES = 1 << 30
TTL_SECONDS = 60
RATE_LIMIT, RATE_SECONDS = 2, 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the pattern also matches a table that is a single file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(TRIGGER_BYTES)).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = table(spark, sf_dir, "events")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")


def _run(df: DataFrame, mode: str, base: str | None = None) -> DataFrame:
    """Run to the end of the input; complete output replaces the table, other output is kept by batch."""
    spark = df.sparkSession
    base = base or f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = df.schema

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={n}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out").select(*schema.names)


def daily_trends(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    w = F.window("ts", "1 day")
    found = events(spark, sf_dir).groupBy(w).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    return _run(found.select(F.col("window.start").cast("date").alias("day"), "n", "mean_value"), "complete", base)


def sliding_junk_rate(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    w = F.window("ts", "1 hour", "10 minutes")
    found = events(spark, sf_dir).groupBy(w).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 20).alias("low"))
    return _run(found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "low"), "complete", base)


def alerts(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    return _run(events(spark, sf_dir).where("value < 5").select("event_id", "user_id", "value"), "append", base)


def counters(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    return _run(events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")), "complete", base)


def score_feed(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """The rule engine over documents as they arrive; the batch plan runs unchanged on the stream."""
    scored = catalog.over(catalog.sql("scored", SCANNED), spark, {"marked": catalog.marked(table(spark, sf_dir, "documents"))}).select("doc_id", "overall", "matched")
    return _run(scored, "append", base)


def latest_by_user(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """Upsert per batch: the newest event of each user replaces the stored one, in the buckets that the batch touches."""
    base = base or f"{folder(spark)}/upsert-{uuid.uuid4().hex}"
    at = lambda x: F.struct(F.col(f"{x}.ts"), F.col(f"{x}.event_id"))
    newer = F.when(F.col("o").isNull() | F.col("n").isNotNull() & (at("n") >= at("o")), F.col("n")).otherwise(F.col("o"))
    store = score_store.keyed(spark, f"{base}/store", "who string, user_id bigint, ts timestamp, event_id bigint, value double", "who", "ts", newer)

    def merge(batch: DataFrame, n: int) -> None:
        store.upsert(batch.selectExpr("coalesce(CAST(user_id AS STRING), '') AS who", "user_id", "ts", "event_id", "CAST(value AS DOUBLE) AS value"))

    query = events(spark, sf_dir).writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(merge).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.rows().select("user_id", "event_id", "value")


accept_ttl = stateful.accept_ttl(TTL_SECONDS)
accept_rate = stateful.accept_rate(RATE_LIMIT, RATE_SECONDS)


def ttl_dedup(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """user_id, event_id, accepted: an event counts unless one of its user did in the last TTL_SECONDS."""
    with stateful.rocksdb(spark):
        found = stateful.accepted(events(spark, sf_dir), F.col("user_id"), F.col("event_id"), "ts", accept_ttl, TTL_SECONDS)
        return _run(found, "append", base).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "accepted")


def rate_limit(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """user_id, event_id, accepted: at most RATE_LIMIT events of a user in any RATE_SECONDS."""
    with stateful.rocksdb(spark):
        found = stateful.accepted(events(spark, sf_dir), F.col("user_id"), F.col("event_id"), "ts", accept_rate, RATE_SECONDS)
        return _run(found, "append", base).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "accepted")


def content_dedup(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """event_id, key, accepted: content (an event's props) is let through unless its key was in the last TTL_SECONDS."""
    with stateful.rocksdb(spark):
        found = stateful.accepted(events(spark, sf_dir), stateful.content_key(F.col("props")), F.col("event_id"), "ts", accept_ttl, TTL_SECONDS)
        return _run(found, "append", base).select(F.col("id").alias("event_id"), "key", "accepted")


def weights(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """Running weight of each user and event type, clamped to [-1, 1] at every step.

    A trigger writes the keys that it touched; of a key the last trigger counts.
    """
    steps = events(spark, sf_dir).select("user_id", F.col("event_type").alias("dim"), F.col("event_id").alias("id"), ((F.col("event_id") % 7 - 3) * 0.3).alias("step"), "ts")
    base = base or f"{folder(spark)}/weights-{uuid.uuid4().hex}"
    with stateful.rocksdb(spark):
        _run(stateful.clamped(steps, "ts"), "update", base)
    rows = spark.read.schema("user_id long, dim string, x double, n long, batch long").parquet(f"{base}/out")
    last = rows.groupBy("user_id", "dim").agg(F.max_by(F.struct("x", "n"), "batch").alias("r"))
    return last.select("user_id", "dim", F.round("r.x", 6).alias("weight"), "r.n")


def rescore(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """Score the pages' hosts again with each file that arrives; the count of pages seen per host."""
    stream = table(spark, sf_dir, "pages")
    host = F.regexp_replace(F.lower(F.expr("try_parse_url(url, 'HOST')")), "^www[.]", "")
    return _run(stream.groupBy(host.alias("host")).agg(F.count("*").alias("n")), "complete", base)


def rescore_pages(spark: SparkSession, sf_dir: str, base: str | None = None) -> DataFrame:
    """url, score, cycle, delta: the pages that arrived with each trigger are scored, and replace the stored scores of their urls.

    A call with the base of an earlier one goes on from there.  Of a url that comes twice in
    a cycle the last page counts; pages without url have no place to be stored.
    """
    base = base or f"{folder(spark)}/rescore-{uuid.uuid4().hex}"
    # a cycle that runs again compares with what its first run compared with
    last = F.when(F.col("o.cycle") == F.col("n.cycle"), F.col("o.prior")).otherwise(F.col("o.score"))
    moved = F.col("n").withField("prior", last).withField("delta", F.round(F.col("n.score") - last, 1))
    store = score_store.keyed(spark, f"{base}/store", "url string, score double, cycle bigint, delta double, prior double", "url", "cycle", F.when(F.col("n").isNull(), F.col("o")).when(F.col("o").isNull(), F.col("n")).otherwise(moved))

    def score(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        newest = batch.where("url IS NOT NULL").groupBy("url").agg(F.max_by(F.struct("page_id", "html"), "page_id").alias("p")).select("url", "p.*")
        aside = f"{base}/texts"
        newest.withColumn("text", pages.text_of("html")).drop("html").write.mode("overwrite").parquet(aside)
        texts = own.read.parquet(aside)
        documents = texts.selectExpr("page_id AS doc_id", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "text")
        scores = texts.join(catalog.over(catalog.sql("scored", SCANNED), own, {"marked": catalog.marked(documents)}).select(F.col("doc_id").alias("page_id"), "overall"), "page_id")
        none = F.lit(None).cast("double")
        store.upsert(scores.select("url", F.col("overall").cast("double").alias("score"), F.lit(n + 1).cast("bigint").alias("cycle"), none.alias("delta"), none.alias("prior")))

    query = table(spark, sf_dir, "pages").select("page_id", "url", "html").writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(score).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.rows().select("url", "score", "cycle", "delta")
