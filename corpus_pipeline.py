"""A corpus pipeline: quality rules, near-duplicates, secrets, mixing and encoding, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, mixing, quality, secrets
from tessera.llm.common import materialise, table
from tessera.llm.queries import byte_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep.

    Null, empty and short texts go; repeated rows and equal texts fare alike; rows without an id are judged by their
    text. Without usable labels the base rule alone decides. No documents, no rows. Other columns stay as they are."""
    return quality.judged(docs, table(spark, sf_dir, "labels")).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the rows with its least doc_id.

    Null and empty texts and rows without an id stay; rows that share an id go or stay by their own texts, and repeated
    rows together. No documents, no rows. Other columns stay as they are."""
    return jaccard.deduplicate(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked and n_chars counted anew.

    Null texts stay null, empty ones empty; repeated rows and equal texts fare alike. No documents, no rows. Other
    columns stay as they are."""
    return secrets.mask(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, none to two times.

    A null source is one of its own; a null or empty text has size 0 and follows its source's rate; a source without
    words goes; equal ids are decided alike. No documents, no rows. Other columns stay as they are."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and round_trip of each document taken: its ids, and whether decoding them gives its
    text again.

    Null and empty texts have no ids; repeated rows are rows of their own. No documents, no rows."""
    found = bpe.encode_checked(docs.select("doc_id", "source", "text"), byte_bpe())
    return found.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixed_sources", mixed_sources),
    ("encoded", encoded),
]

#: Learned rules, the similarity join and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
