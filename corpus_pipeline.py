"""A training corpus from ``documents``: filter, de-duplicate, redact, mix, encode.

Each stage takes what the one before kept, writes nothing of its own but intermediate tables in
the session's shared folder, and returns the columns of ``documents``; the last returns token ids.
No stage can be told in SQL as a whole, so ``ORACLE_SQL`` is None and tests hold the stages
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import mixing, neardup, pieces, quality, queries, secret_scan
from quantloom.llm.runtime import table, written

#: A document stays if its probability of label 1 is this high.
LEAST_QUALITY = 0.3
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among ``docs``, doesn't reject.

    Null and empty texts score by the labels' shares; with labels mostly 1 they stay.
    """
    model = queries.quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, "__score").where(F.col("__score") >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of five-word shingles."""
    return neardup.deduplicated(docs, size=5, similarity=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets replaced by a mark and ``n_chars`` brought up to date."""
    clean = secret_scan.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.char_length("text").cast(kind))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights say."""
    return mixing.mix(docs)


def encoded_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded) of every document of the mix; ``decoded`` says whether the ids give the text back."""
    rows = pieces.encoded(docs, queries.vocabulary("piece_bpe_32k.model"))
    return rows.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("secret scans", without_secrets),
    ("mixing sources", mixed_sources),
    ("SentencePiece encoding and decoding", encoded_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
