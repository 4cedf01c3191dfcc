"""From raw to token-counted documents in five stages.

Each stage works on what the one before kept, written as Parquet in between. All but the last
return the columns of the documents table; a stage that changes a text sets ``n_chars`` anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import bpe, cleaning, mixing, simhash, toxicity
from creditloom.llm.tables import table
from creditloom.session import shared_folder

# Near-duplicates: words of a shingle, Jaccard similarity.
SHINGLE = 5
SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain of classifiers does not find toxic."""
    judged = toxicity.judge(docs, table(spark, sf_dir, "labels"), docs.columns)
    return judged.where(~F.col("toxic")).select(*docs.columns)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their bad lines removed, less those that lost too much."""
    packed = docs.select(F.struct("*").alias("doc_id"), "text")  # the whole row rides as the id
    kept = cleaning.clean(packed).where("kept")
    changed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return kept.select(
        *[changed.get(name, F.col(f"doc_id.`{name}`")).alias(name) for name in docs.columns]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar shingle sets, the one with the smallest id."""
    return simhash.deduplicated(docs, SHINGLE, SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emitted(mixing.mix(docs))


def count_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes, per document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trips(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", clean_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("byte-level bpe", count_tokens),
]

# Trained models, 64-bit hashes and BPE merges are beyond SQL; tests hold a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what lies between them is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/stage-{place}")
            docs = spark.read.parquet(f"{folder}/stage-{place}")
    return docs
