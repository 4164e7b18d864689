"""From raw documents to packed training sequences, in stages that each work on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gatecrest.llm import exact_dedup, mixing, ngram_jaccard, packing, toxicity
from gatecrest.llm.common import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on labels.parquet, doesn't reject. Null, empty and wordless texts stay; repeated rows go together; without labels of both classes all stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same bytes of text that of the least doc_id, so one of repeated rows and one of all empty texts. Null texts stay."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the least doc_id. Null ids and texts, and texts without a word, are in no group and stay."""
    return ngram_jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of training. Those for which their source's weights leave no demand go; texts without a token (null, empty, blank) stay, in their place; a null source is a source of its own."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, bin_tokens, doc_id, piece, start, tokens, bin_offset, position) of the pieces that fill sequences. Texts without a token take no room and have no row; a null doc_id stays null."""
    return packing.pack_in_order(docs, tree=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: A trained classifier, a similarity join and a packing heuristic are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; each result is written to the shared folder and read again.

    Rows with null, empty, very long or repeated texts, ties and columns beside those of documents are treated as the
    stages say, none of which fails on them; all stages but the last keep all columns. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
