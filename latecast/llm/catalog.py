"""The queries of this subpackage: each applies one operator, with production parameters, to its whole
table, and derives the agreed columns from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latecast.llm import (
    byte_bpe, exact_dedup, line_dedup, mixing, near_dup, phrases, quality,
    runs, secret_crf, substrings, token_file, topk, warc,
)
from latecast.llm.shared import WORD, documents, whole_text

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.col("sha").alias("text_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed",
        F.sha2(whole_text("text").cast("binary"), 256).alias("text_sha256"),
    )


def op3_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secret_crf.scan(docs, secret_crf.train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), count("crf").alias("n_added"),
    )


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_file.write_tokens(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")
    )
    return token_file.read_tokens(manifest).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judged(docs, quality.train(docs)).select(
        "doc_id", F.col("quality_score").alias("score"), F.col("quality_keep").alias("kept")
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_warc(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    encoded = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, decoded_col="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.transform("removed", lambda s: s["length"])
    found = substrings.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Texts of ids whose checksum ends in 0 repeat their own words from some place on; others stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    listed = docs.select("doc_id", "text", (F.floor(h / 10)).alias("g"), F.when(
        h % 10 == 0, F.regexp_extract_all(whole_text("text"), F.lit(f"({WORD})"), F.lit(1))
    ).alias("w"))
    from_ = F.col("g") % F.size("w")
    period = 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))
    listed = listed.withColumn("a", F.when(F.size("w") > 0, from_)).withColumn("p", period)
    repeated = F.expr("transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)]))")
    text = F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(repeated, " "))
    return listed.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_periods(documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(listed, lambda r: F.concat(r, F.lit("\n"))), "")
    start, length, period = -best["start"], best["length"], -best["period"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"),
        length.alias("length"), period.alias("period"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).withColumn("exponent_milli", F.expr("1000 * length div period"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.phrase_counts(documents(spark, sf_dir)))


def queries() -> dict[str, Query]:
    found = [
        op1_exact_dedup, op2_line_dedup, op3_secret_crf, op4_token_file, op5_near_dup,
        op6_exact_topk, op7_source_mixing, op8_quality_classifier, op9_warc, op10_byte_bpe,
        op11_substring_dedup, op12_periodic_runs, op13_collocations,
    ]
    return {f.__name__: f for f in found}
