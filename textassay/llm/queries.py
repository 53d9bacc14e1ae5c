"""The numbered queries: each applies one operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.llm import decontaminate, jaccard, licenses, lm, mixing, oracles, pagetext, passages, periodic, quality, sharding, tokens, toxicity, whitening
from textassay.llm.io import table


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    found = quality.score(docs, model)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").selectExpr("*", "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) AS h")
    # a tenth of the documents get a repetition; only their texts are taken apart here
    words = r"filter(split(text, r'[ \t\n\x0B\f\r]+'), w -> w != '')"
    cut = docs.selectExpr("doc_id", "text", "h", f"CASE WHEN h % 10 = 0 THEN {words} END AS w", "h DIV 10 AS g")
    cut = cut.selectExpr("*", "CASE WHEN size(w) > 0 THEN g % size(w) END AS a")
    cut = cut.selectExpr("*", "1 + (size(w) - a) DIV (3 + g % 8) AS p")
    planted = "concat_ws(' ', transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[CAST(a + (i - a) % p AS INT)] END))"
    rows = cut.selectExpr("doc_id", f"CASE WHEN size(w) > 0 THEN {planted} ELSE text END AS text")
    listed = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))"
    best = "best.start, best.length, best.period, 1000 * best.length DIV best.period AS exponent_milli"
    return periodic.runs(rows).selectExpr("doc_id", "CAST(size(runs) AS BIGINT) AS n_runs", *best.split(", "), f"sha2({listed}, 256) AS runs_sha256", "sha2(collapsed, 256) AS collapsed_sha256")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("pmod(crc32(CAST(doc_id AS STRING)), 4) != 2")
    model = toxicity.train(docs.where("NOT held_out"), labels)
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_page_text": op1_page_text,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_lm_score": op8_lm_score,
    "op9_license_scan": op9_license_scan,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_toxicity": op13_toxicity,
}
ORACLES: dict[str, str] = {"op6_decontamination": oracles.OP6}
