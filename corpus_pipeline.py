"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents. No single SQL statement can express them, so ORACLE_SQL is None and the tests hold
the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import exact_dedup, jaccard_join, packing, quality, secret_scan
from tallyframe.llm.shared import written


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fit on the labelled ones among docs, doesn't reject.

    Null and empty texts are scored by their empty shape, very long ones whole in blocks, equal texts alike; rows without doc_id are
    scored too; of a doc_id labelled twice the greatest label counts; without labels of both classes all scores are their share, or 0.5. An
    empty table gives none; extra columns stay, whatever their names.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts.

    Null counts as empty and a run of blanks as one space; of equal texts the smallest doc_id stays (null last), of rows that repeat
    whole one; very long texts are compared whole. An empty table gives none; extra columns stay, whatever their names.
    """
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of documents linked by five-word shingles.

    Texts without words, null ones among them, are linked with nothing and stay; very long texts count with all their shingles; at exactly the
    threshold two are linked; of a group the smallest doc_id stays; rows of one doc_id stay or go together, rows without one stay. An empty table gives none; extra columns stay, whatever their names.
    """
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts, encoded ones too, replaced by a mark.

    Null and empty texts stay as they are; very long ones are scanned whole, and large inflated layers in pieces; spans that overlap are
    masked together; rows are taken one by one, so repeated ones and those without doc_id stay. n_chars is counted anew. An empty table gives none; extra columns stay, whatever their names.
    """
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a training sequence, with its token ids.

    A null or empty text is its end mark alone; a very long one is cut into pieces of at most a sequence, each id in exactly one; repeated rows and
    rows without doc_id are packed each for itself. An empty table gives none; of the columns doc_id and text are read, others may have any name.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
