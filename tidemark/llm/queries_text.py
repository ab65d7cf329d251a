"""One query for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    licenses,
    middle,
    mixing,
    packing,
    pii,
    quality,
    ranking,
    sharding,
    simhash,
    sql,
    suffixes,
    tokens,
    urls,
)
from tidemark.llm.shared import fresh_path, table

TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    hits = decontaminate.scan(documents(spark, sf_dir), benchmark, keep=["doc_id"])
    return hits.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        F.col("hits.contaminated").alias("contaminated"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan(documents(spark, sf_dir))
    return scanned.select(
        "doc_id",
        *[
            F.col("license")[c].alias(c)
            for c in (
                "n_words",
                "n_base",
                "first_word",
                "last_word",
                "base_labels",
                "labels",
                "score",
            )
        ],
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    drawn = mixing.draw(docs)
    return drawn.select("doc_id", "source", "tokens", "epoch", "block", "place")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return tokens.write_and_read(documents(spark, sf_dir), path)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(documents(spark, sf_dir))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.judge(pages)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    )
    return sharding.assign(docs)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id",
        *[
            F.col("quality")[c].alias(c)
            for c in (
                "n_words",
                "word_chars",
                "n_symbols",
                "n_dup_lines",
                "n_repeat_words",
                "base_failed",
                "kept",
            )
        ],
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = pii.detect(documents(spark, sf_dir))
    return detected.select(
        "doc_id",
        *[F.size(F.col(f"pii.{k}")).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.shown(kinds=pii.KINDS), 256).alias("base_sha256"),
        pii.shown().alias("spans"),
    )


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "terms")
    ranking.build(documents(spark, sf_dir), path)
    return ranking.search(spark.read.parquet(path), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle.transform(documents(spark, sf_dir))
    output, form = F.col("fim.output"), F.col("fim.form")
    return cut.select(
        "doc_id",
        *[F.col("fim")[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(middle.restored(output, form), 256).alias("restored_sha256"),
    )


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_license_scan,
        op3_source_mixing,
        op4_token_files,
        op5_simhash_near_dedup,
        op6_url_filters,
        op7_sharding,
        op8_quality_rules,
        op9_personal_data,
        op10_suffix_array_dedup,
        op11_ranked_search,
        op12_fill_in_middle,
        op13_best_fit_packing,
    )
}
SQL = {
    "op1_benchmark_decontamination": sql.op1(),
    "op2_license_scan": sql.op2(),
    "op7_sharding": sql.op7(),
    "op8_quality_rules": sql.op8(),
    "op10_suffix_array_dedup": sql.op10(),
    "op11_ranked_search": sql.op11(),
    "op12_fill_in_middle": sql.op12(),
}
