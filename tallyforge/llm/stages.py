"""A corpus pipeline of this package's operators. Each stage's result is written as Parquet and reread.

Documents that the quality rules reject go; of near-duplicates (five-word Jaccard similarity of 0.8 or more, of candidates
by SimHash and MinHash) one stays; secrets are replaced in the texts; the sources are mixed to their target weights (a document may come twice or not at
all); the rest is encoded.

Edge cases: a null or empty text has no words and fails the quality rules' base (fewer than 50 words), so it goes in the
first stage; a null lang or source is a group of its own; null ids stay, and count as the largest where one document of
near-duplicates is picked; of repeated rows one stays; very long texts are handled whole; extra columns are carried
through all stages but the last, which returns its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing, neardup, pieces, quality, secrets
from .common import save, table

#: Sketches, trained trees and components aren't SQL; tests/llm/test_pipeline.py compares with brute-force versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a document of the mix: doc_id, lang, source, number of ids, the ids themselves and their digests."""
    return pieces.encode(docs, pieces.model_path(), keep=["doc_id", "lang", "source", "n_tokens", "piece_ids", "ids_sha256", "decoded_sha256"])


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup by five-word shingles", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
