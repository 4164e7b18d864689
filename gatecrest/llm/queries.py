"""The operators on their whole tables, with production parameters, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatecrest.llm import ann, exact_dedup, mixing, ngram_jaccard, packing, quality, secret_scan, sharding, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": lambda s, d: ngram_jaccard.near_duplicates(table(s, d, "documents")),
        "op2_nearest_neighbours": lambda s, d: ann.nearest(table(s, d, "embeddings")),
        "op3_exact_dedup": lambda s, d: exact_dedup.duplicate_map(table(s, d, "documents")),
        "op4_url_filter": lambda s, d: url_filter.decide(table(s, d, "pages")),
        "op5_secret_scan": lambda s, d: secret_scan.scan(table(s, d, "documents")),
        "op6_mixing": lambda s, d: mixing.schedule(table(s, d, "documents")),
        "op7_toxicity": lambda s, d: toxicity.classify(table(s, d, "documents"), table(s, d, "labels")),
        "op8_best_fit_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "op9_quality": lambda s, d: quality.classify(table(s, d, "documents"), table(s, d, "labels")),
        "op10_sharding": lambda s, d: sharding.assign(table(s, d, "documents")),
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents",
        "op4_url_filter": url_filter.oracle(),
        "op5_secret_scan": secret_scan.oracle(),
        "op6_mixing": mixing.oracle(),
    }
