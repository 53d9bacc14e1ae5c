"""Queries that are DataFrame programs rather than one SQL text, with their oracles where SQL has one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textassay.functions import phrases
from textassay.functions.dialect import SCANNED, SPARK
from textassay.functions.packs import LATIN
from textassay.operators import hamming, pages, paragraphs, quantiles, simhash
from textassay.plans import catalog, stages
from textassay.sources.shared import kept
from textassay.streaming import jobs

#: Queries of a pass, and vectors that they are compared with at a time: a task holds their product.
QUERY_BLOCK, VECTORS = 2048, 512
NEIGHBOURS = 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nearest(names: np.ndarray, queries: np.ndarray, batches):
    """query_id, vec_id, cosine of the NEIGHBOURS nearest rows to each query in these batches; VECTORS rows are compared at a time."""
    norms = np.linalg.norm(queries, axis=1)[:, None]
    ids, best = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
    for batch in batches if len(names) else ():
        for start in range(0, batch.num_rows, VECTORS):
            part = batch.slice(start, VECTORS)
            own, vectors = part.column("vec_id").to_numpy(), part.column("embedding")
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
            near = (queries @ x.T) / (norms * np.linalg.norm(x, axis=1)[None, :])
            near[names[:, None] == own[None, :]] = -2
            ids, best = np.hstack([ids, np.broadcast_to(own, near.shape)]), np.hstack([best, near])
            top = np.lexsort((ids, -best), axis=1)[:, :NEIGHBOURS]
            ids, best = np.take_along_axis(ids, top, 1), np.take_along_axis(best, top, 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ids.shape[1])), pa.array(ids.ravel()), pa.array(best.ravel())], ["query_id", "vec_id", "cosine"])


def embedding_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors by cosine of each vector whose id is divisible by 100, queries taken in blocks."""
    rows = _table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    ids = rows.where("vec_id % 100 = 0").select("vec_id", "embedding")
    blocks = -(-ids.count() // QUERY_BLOCK)
    found = None
    for b in range(max(1, blocks)):
        own = ids.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))) == b).toPandas()  # about QUERY_BLOCK vectors
        shared = spark.sparkContext.broadcast((own["vec_id"].to_numpy(), np.array(own["embedding"].tolist(), np.float64).reshape(len(own), -1)))

        def run(batches, shared=shared):
            return _nearest(*shared.value, batches)

        part = rows.select("vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, cosine double")
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id"))
    return found.where("cosine > -2").withColumn("rn", place).where(F.col("rn") <= NEIGHBOURS).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rn")


def _least_reached(spark: SparkSession, sf_dir: str, name: str, links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of links(a, b) reaches."""
    both = kept(spark, sf_dir, f"{name}-links", lambda: links.union(links.select("b", "a")).distinct())
    labels = kept(spark, sf_dir, f"{name}-0", lambda: both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")))
    n = 0
    while True:
        n += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = step.join(jump.hint("merge"), "label").select("node", "old", F.least("label", "far").alias("label"))
        step = kept(spark, sf_dir, f"{name}-{n}", lambda step=step: step)
        labels = step.select("node", "label")
        if step.where("old != label").isEmpty():
            return labels


def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest document of each group of near-copies: fingerprints within distance that link, transitively.

    Links are taken by rising distance, and only those between groups that nearer ones have not
    joined: their number follows that of the fingerprints, where the pairs grow with its square.
    """
    nodes = catalog.run_text(catalog.step("nodes", SPARK), spark, sf_dir).where("doc_id IS NOT NULL")
    labels = kept(spark, sf_dir, "labels-0", lambda: nodes.select("fingerprint", "doc_id"))
    for distance in range(1, simhash.K + 1):
        links = hamming.near(labels.withColumn("query", F.lit(False)), distance, unlike=True).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
        joined = _least_reached(spark, sf_dir, f"reached-{distance}", links)
        merged = labels.join(joined.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("fingerprint", F.coalesce("label", "doc_id").alias("doc_id"))
        labels = kept(spark, sf_dir, f"labels-{distance}", lambda merged=merged: merged)
    rows = catalog.run_text("SELECT doc_id, fingerprint FROM fp WHERE kind = 'document'", spark, sf_dir)
    return rows.join(labels.withColumnRenamed("doc_id", "cluster").hint("merge"), "fingerprint").select("doc_id", "cluster")


FEATURES = ["char_count", "word_count", "line_count", "avg_line_length", "exclamations", "questions", "ellipses", "scam_keywords", "emotional_patterns", "ad_keywords", "ai_patterns", "paragraphs_n", "link_n", "number_ratio", "char_diversity", "sentence_count", "avg_sentence_length"]


def ml_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and score of each document by a logistic regression on its features, fitted on the labels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    feats = kept(spark, sf_dir, "text_features", lambda: catalog.run("text_features", spark, sf_dir))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")).where("label IS NOT NULL")
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"), LogisticRegression(maxIter=30, regParam=0.01)]
    model = Pipeline(stages=stages).fit(feats.join(labels, "doc_id"))
    p = vector_to_array("probability")[1]
    category = F.when(p < 0.25, "junk").when(p < 0.5, "low").when(p < 0.75, "medium").otherwise("good")
    score = F.when(p < 0.25, 15.0).when(p < 0.5, 40.0).when(p < 0.75, 60.0).otherwise(80.0)
    return model.transform(feats).select("doc_id", category.alias("category"), score.alias("score"), F.round(F.greatest(p, 1 - p), 6).alias("conf"))


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def search_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return paragraphs.anchors(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")))


def ttl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.ttl_dedup(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))


def content_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.content_dedup(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))


def staged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the default pipeline of stages, with the errors of each."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("raw"))
    found = stages.default().run(rows)
    return found.select("doc_id", F.col("overall").cast("double").alias("overall"), "verdict", "cut", F.array_join("errors", "; ").alias("errors"), F.size("stages").alias("n_stages"))


def planted_lines() -> list[str]:
    """For each phrase of the Latin pack a line that holds it and two others, so that every rule fires on some document."""
    words = [e.phrase for e in phrases.entries(LATIN)]
    n = len(words)
    return [f"{words[k]}; {words[(7 * k + 1) % n]}, {words[(3 * k + 2) % n]}! Last chance before it's too late" + "!" * (k % 9) for k in range(n)]


def _planted(name: str):
    """A rule query over all documents with a planted line each, by their id."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = planted_lines()
        line = F.element_at(F.array(*map(F.lit, lines)), (F.col("doc_id") % len(lines) + 1).cast("int"))
        docs = catalog.spread(_table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", F.concat_ws("\n", "text", line).alias("text"))
        return catalog.over(catalog.sql(name, SCANNED), spark, {"marked": catalog.marked(docs)})

    return run


PLANTED = {"rule_score_planted": "rule_score_all", "rule_hits_planted": "rule_hits_long", "evidence_planted": "evidence_locate"}


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(_table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def consistent_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(_table(spark, sf_dir, "events"), "user_id", "value", {"median": 0.5})


QUERIES = {name: _planted(of) for name, of in PLANTED.items()} | {
    "latency_percentiles": latency_percentiles,
    "consistent_median": consistent_median,
    "staged_documents": staged_documents,
    "embedding_neighbors": embedding_neighbors,
    "near_dup_clusters": near_dup_clusters,
    "ml_class": ml_class,
    "page_extract": page_extract,
    "search_anchor": search_anchor,
    "stream_score_feed": jobs.score_feed,
    "stream_ttl_dedup": ttl_counts,
    "stream_rate_limit": jobs.rate_limit,
    "stream_content_dedup": content_counts,
    "stream_daily_trends": jobs.daily_trends,
    "stream_sliding_junk_rate": jobs.sliding_junk_rate,
    "stream_alerts": jobs.alerts,
    "stream_counters": jobs.counters,
    "stream_weights": jobs.weights,
    "stream_upsert": jobs.latest_by_user,
    "stream_rescore": jobs.rescore,
    "stream_rescore_pages": jobs.rescore_pages,
}


def _ttl(key: str, name: str) -> str:
    """Events of each key in order of time, folded: the last accepted time and how many there were."""
    start, event = "{'t': CAST(-1e12 AS DOUBLE), 'l': CAST(-1e12 AS DOUBLE), 'n': 0}", "{'t': epoch(ts), 'l': CAST(0 AS DOUBLE), 'n': 0}"
    fits = f"b.t - a.l > {jobs.TTL_SECONDS}"
    step = f"{{'t': b.t, 'l': CASE WHEN {fits} THEN b.t ELSE a.l END, 'n': a.n + CASE WHEN {fits} THEN 1 ELSE 0 END}}"
    return f"SELECT {key} AS {name}, count(*) AS n, CAST(list_reduce(list_prepend({start}, list({event} ORDER BY ts, event_id)), lambda a, b: {step}).n AS BIGINT) AS accepted FROM events GROUP BY ALL"


#: Two accepted times and the accepted events of each user, folded in order of time.
RATE = f"""
WITH s AS (SELECT user_id, list_reduce(list_prepend({{'t': CAST(-1e12 AS DOUBLE), 'id': CAST(-1 AS BIGINT), 'a': CAST(-1e12 AS DOUBLE), 'b': CAST(-1e12 AS DOUBLE), 'e': CAST([] AS BIGINT[])}},
  list({{'t': epoch(ts), 'id': event_id, 'a': CAST(0 AS DOUBLE), 'b': CAST(0 AS DOUBLE), 'e': CAST([] AS BIGINT[])}} ORDER BY ts, event_id)),
  lambda x, y: CASE WHEN y.t - x.a >= {jobs.RATE_SECONDS} THEN {{'t': y.t, 'id': y.id, 'a': x.b, 'b': y.t, 'e': list_append(x.e, y.id)}} ELSE {{'t': y.t, 'id': y.id, 'a': x.a, 'b': x.b, 'e': x.e}} END).e AS e FROM events GROUP BY user_id)
SELECT v.user_id, v.event_id, list_contains(s.e, v.event_id) AS accepted FROM events v JOIN s ON v.user_id IS NOT DISTINCT FROM s.user_id"""
assert jobs.RATE_LIMIT == 2  # RATE holds two times


def _oracles() -> dict[str, str]:
    from textassay.functions.dialect import DUCK

    chain = catalog.sql("overall_score", DUCK)
    feed = chain[: chain.rindex("SELECT doc_id, overall,")] + "SELECT doc_id, overall, matched FROM scored"
    listed = ", ".join(DUCK.lit(line) for line in planted_lines())
    line = f"list_extract([{listed}], doc_id % {len(planted_lines())} + 1)"
    planted = {name: catalog.sql(of, DUCK).replace("FROM documents", f"FROM (SELECT doc_id, lang, source, concat_ws(chr(10), text, {line}) AS text FROM documents)") for name, of in PLANTED.items()}
    bare = "regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"
    judged = f"(SELECT doc_id, lang, source, CASE WHEN length(b) > 10000 THEN concat(left(b, 5000), chr(10), right(b, 2000)) ELSE b END AS text FROM (SELECT *, {bare} AS b FROM documents))"
    staged = catalog.sql("scored", DUCK).replace("FROM documents", f"FROM {judged}")
    verdict = "CASE WHEN overall < 40 THEN 'junk' WHEN overall <= 60 THEN 'suspicious' WHEN overall <= 80 THEN 'normal' ELSE 'quality' END"
    return planted | {
        "staged_documents": f"SELECT s.doc_id, CASE WHEN t <> '' THEN overall END AS overall, CASE WHEN t <> '' THEN {verdict} END AS verdict, CASE WHEN t <> '' THEN length({bare.replace('text', 'd.text')}) > 10000 END AS cut, CASE WHEN t = '' THEN 'extract: no content' WHEN d.source IS NULL THEN 'enrich: no source' ELSE '' END AS errors, CAST(CASE WHEN t = '' THEN 0 WHEN d.source IS NULL THEN 4 ELSE 5 END AS INT) AS n_stages FROM ({staged}) s JOIN documents d ON s.doc_id = d.doc_id",
        "embedding_neighbors": f"SELECT query_id, vec_id, round(c, 6) AS cosine, CAST(rn AS INT) AS rn FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rn FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) WHERE rn <= {NEIGHBOURS}",
        "stream_score_feed": feed,
        "stream_ttl_dedup": _ttl("user_id", "user_id"),
        "stream_content_dedup": _ttl("CASE WHEN starts_with(props, 'http://') OR starts_with(props, 'https://') THEN 'url:' || lower(trim(props)) ELSE 'hash:' || substring(sha256(props), 1, 16) END", "key"),
        "stream_rate_limit": RATE,
        "stream_daily_trends": "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY CAST(ts AS DATE)",
        "stream_sliding_junk_rate": "SELECT start, count(*) AS n, count(CASE WHEN value < 20 THEN 1 END) AS low FROM (SELECT value, time_bucket(INTERVAL '10 minutes', ts) - k * INTERVAL '10 minutes' AS start FROM events, range(6) r(k)) GROUP BY start",
        "stream_alerts": "SELECT event_id, user_id, value FROM events WHERE value < 5",
        "stream_counters": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
        "stream_weights": catalog.sql("weight_accumulate", DUCK),
        "stream_upsert": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
        "stream_rescore": f"SELECT {DUCK.host('url')} AS host, count(*) AS n FROM pages GROUP BY ALL",
    }


ORACLES = _oracles()
