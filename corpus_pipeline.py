"""A training-data pipeline over ``documents``: quality rules, near-duplicates,
secrets, source mixing, SentencePiece ids.

Each stage reads what its predecessor kept and returns the columns of
``documents``; the last adds the piece ids. ``run`` writes every stage's result as
Parquet in the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwright.llm import minhash, mixing, pieces, quality, queries, secrets, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the classifier reject."""
    labels = shared.read_table(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.fit(shared.read_table(spark, sf_dir, "documents"), labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document (the smallest id) of each group at similarity 0.8 on five-word shingles."""
    return minhash.keep_one(docs, shingle=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in every text; all documents stay."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes words of a document."""
    return mixing.mixed_rows(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_crc32, decoded_bytes, round_trip, piece_ids."""
    return pieces.encode_table(docs, model or queries.tokenizer_file("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("sentencepiece_ids", sentencepiece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.materialise(stage(spark, docs, sf_dir), name)
    return docs


#: Classifier, similarity groups and shortest paths are beyond SQL; the stages are
#: tested against brute force instead.
ORACLE_SQL = None
