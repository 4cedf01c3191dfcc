"""One query per operator, over its whole table, and the SQL twins of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import (
    bpe, cleaning, extraction, lexical, licenses, maxscore, merkle, mixing, repair, simhash,
    token_counts, toxicity, urls,
)
from creditloom.llm.tables import table
from creditloom.session import shared_folder

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 1
TOKEN_LIMIT = 512
RANKS = 20


def op1_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Re-Pair shards and read back from the files."""
    folder = f"{shared_folder(spark)}/repair-shards"
    repair.shards(table(spark, sf_dir, "documents"), WORD_TOKENIZER, END_ID).write.parquet(folder)
    return repair.digests(spark.read.parquet(folder))


def op2_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and the licences they make up, per document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict per page: the rule list's, else that of rules mined from pages of labelled documents."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, labels=urls.document_labels(pages, table(spark, sf_dir, "labels")))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories and the verdict, per document."""
    judged = toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return judged.withColumn("kept", ~F.col("toxic"))


def op5_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of line-first cleaning, per document."""
    return cleaning.clean(table(spark, sf_dir, "documents")).drop("clean_text")


def op6_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for each vector whose id 50 divides."""
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of the bytes they decode to."""
    return bpe.round_trips(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix to the sources' target weights takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return mixed.select(
        "row.doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "row.source",
    )


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate group."""
    return simhash.groups(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its possibly forged leaf leads to the root."""
    return merkle.proofs(table(spark, sf_dir, "documents"))


def op12_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, TOKEN_LIMIT)


def op13_shared_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item."""
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical.search(documents, items, "item_id", RANKS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_repair_token_files, op2_license_sentences, op3_url_rules, op4_toxicity_chain,
        op5_line_cleaning, op6_maxscore_top_k, op7_prefix_bpe, op8_systematic_mix,
        op9_text_density, op10_simhash_groups, op11_merkle_manifest,
        op12_whole_token_counts, op13_shared_lexical_search,
    )
}
