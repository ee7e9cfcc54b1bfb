"""Corpus pipeline: quality classifier, near-duplicate groups, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result of one is written as Parquet and reread
as the next one's ``docs``. All stages but the last return the columns of ``docs``; the last returns pieces of
sequences. Null texts count as empty; repeated rows, null ids, empty tables and further columns behave as stated by
the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard, packing, quality, secrets
from plumbline.llm.common import importable, table, written

#: Five-word shingles, a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects."""
    model = quality.train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    own = "_" * max(map(len, docs.columns))  # longer than the columns that are there, so that none is replaced
    scored = quality.score_documents(docs, model, f"{own}score", f"{own}predicted")
    return scored.where(F.col(f"{own}predicted") == 1).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that with the smallest doc_id; rows with a null doc_id stay."""
    return jaccard.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes secrets out of the texts."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", redact_secrets),
    ("packing", pack),
]
#: SQL can't express the classifier and the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
